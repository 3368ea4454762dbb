"""SQL over the same tables that gives the rows of the named queries."""

from __future__ import annotations

from marquee import constants

ORACLES: dict[str, str] = {}

_SITE = "http://films.example"
_SPACES = r"[ \t\n\x0B\f\r]+"
_STOP_WORDS = ",".join("'" + word.replace("'", "''") + "'" for word in constants.STOP_WORDS)
_FILM_URL = (
    f"'{_SITE}/film/' || ((doc_id * 7) % 1000000 + line_no) || '_' || movie_id || '.html'"
)


def _stem(column: str) -> str:
    upper, lower = constants.ASCII_UPPER, constants.ASCII_LOWER
    marks = constants.ASCII_PUNCTUATION.replace("'", "''")
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return (
        f"regexp_replace(trim(translate({column}, '{upper}{marks}', '{lower}'), {spaces}), ' +', ' ', 'g')"
    )


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_SPACES}'), lambda w: w <> '')"


_LINES = """
lines AS (
  SELECT doc_id, lang, source, line_no, title,
         CAST('0x' || substr(md5(doc_id || ':' || line_no), 1, 15) AS BIGINT) AS movie_id,
         doc_id + line_no AS mark, length(title) AS size
  FROM (SELECT doc_id, lang, source, unnest(p) AS title, unnest(range(len(p))) AS line_no
        FROM (SELECT *, string_split(text, chr(10)) AS p FROM documents)))
"""

_DUMP = _LINES + """,
dump AS (
  SELECT movie_id,
    CASE WHEN mark % 5 = 0 THEN 'UNRELEASED' ELSE 'RELEASED' END AS status,
    CAST(CASE WHEN mark % 5 = 0 THEN -1 ELSE 1 + mark % 3 END AS FLOAT) AS hours,
    CAST(CASE WHEN mark % 5 = 0 THEN -1 ELSE mark % 60 END AS FLOAT) AS minutes,
    title,
    CASE WHEN mark % 13 = 0 THEN '' ELSE 'day ' || mark % 30 END AS date,
    '/cover/' || movie_id AS cover,
    'Director ' || mark % 211 AS director,
    [source, CASE WHEN size > 200 THEN 'long' ELSE 'short' END] AS genre,
    [' ' || lang] AS nationalities,
    CAST(-1 AS FLOAT) AS score_press, CAST(-1 AS FLOAT) AS reviews_press,
    CAST(CASE WHEN mark % 11 = 0 THEN -1 ELSE (size % 50) / 10.0::DOUBLE END AS FLOAT) AS score_viewers,
    CAST(CASE WHEN mark % 11 = 0 THEN -1 ELSE size % 500 END AS FLOAT) AS reviews_viewers,
    ['/shot/' || movie_id] AS pictures,
    [lang, NULL, source] AS actors,
    'Line ' || line_no AS synopsis,
    '<p>' || source || '</p>' AS misc,
    CASE WHEN mark % 3 = 0 THEN '' ELSE 'http://t/' || movie_id || '.mp4' END AS trailer,
    CAST((doc_id * 7) % 1000000 + line_no AS FLOAT) AS rank
  FROM lines)
"""

_CATALOG = _DUMP + """,
cat AS (
  SELECT movie_id, status, hours, minutes, title, director, genre, score_viewers, reviews_viewers,
    pictures, synopsis, misc, trailer,
    CAST(trunc(rank - (CASE WHEN trailer = '' THEN CAST(600000 AS FLOAT) ELSE CAST(0 AS FLOAT) END)
      + reviews_viewers * CAST(10 AS FLOAT) + score_viewers * CAST(10000 AS FLOAT)) AS INTEGER) AS rank,
    '/' || CAST(trunc(rank) AS INTEGER) || '.jpg' AS local_cover,
    CASE WHEN date = '' THEN 'Date de sortie inconnue' ELSE date END AS date,
    list_transform(nationalities, lambda v: substring(v, 2)) AS nationalities,
    list_filter(actors, lambda v: v IS NOT NULL) AS actors
  FROM dump)
"""


def _flat(*names: str) -> str:
    return ", ".join(f"array_to_string({n}, '|') AS {n}" for n in names)


ORACLES["catalog_derive"] = f"""
WITH {_CATALOG}
SELECT movie_id, title, rank, local_cover, date, {_flat("nationalities", "actors", "genre")} FROM cat
"""

_DETAIL = f"""
  {_flat("actors", "genre", "nationalities", "pictures")}, local_cover AS cover, date, director, hours,
  minutes, misc, reviews_viewers, score_viewers, status, synopsis, title, trailer
"""

ORACLES["catalog_detail"] = f"WITH {_CATALOG} SELECT movie_id, {_DETAIL} FROM cat"

_NUMBER = "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')"

ORACLES["catalog_display"] = f"""
WITH {_CATALOG}
SELECT movie_id, title,
  CASE WHEN score_viewers = -1 THEN '?'
    ELSE {_NUMBER.format("floor(CAST(score_viewers AS DOUBLE) * 10 + 0.5) / 10")} END AS score,
  CASE WHEN reviews_viewers = -1 THEN CAST(0 AS FLOAT) ELSE reviews_viewers END AS reviews,
  concat_ws('&nbsp;&nbsp|&nbsp;&nbsp;',
    CASE WHEN hours <> -1 THEN {_NUMBER.format("hours")} || 'h ' || {_NUMBER.format("minutes")} || ' min' END,
    CASE WHEN len(genre) > 0 THEN array_to_string(genre, ', ') END, date) AS duration_genre_date,
  director || ' (' || date || ')' AS director_date
FROM cat
"""

ORACLES["catalog_round_trip"] = f"""
WITH {_DUMP}
SELECT status, hours, minutes, title, date, cover, director, {_flat("genre", "nationalities", "pictures")},
  array_to_string(list_transform(actors, lambda v: coalesce(v, '-')), '|') AS actors,
  score_press, reviews_press, score_viewers, reviews_viewers, synopsis, misc, trailer, rank
FROM dump
"""

# --- text ---------------------------------------------------------------------------------

ORACLES["stem_titles"] = f"WITH {_LINES} SELECT movie_id, {_stem('title')} AS text FROM lines"

ORACLES["token_counts"] = f"""
WITH {_LINES}
SELECT movie_id, len({_words(_stem("title"))}) AS words,
  len(list_filter({_words(_stem("title"))}, lambda w: w NOT IN ({_STOP_WORDS}))) AS content
FROM lines
"""

ORACLES["content_word_counts"] = f"""
WITH {_LINES}, w AS (SELECT unnest({_words(_stem("title"))}) AS word FROM lines)
SELECT word, count(*) AS count FROM w WHERE word NOT IN ({_STOP_WORDS}) GROUP BY word
"""

_PART_POSTINGS = f"""
names AS (SELECT p_partkey AS movie_id, p_size AS rank, {_stem("p_name")} AS text FROM part),
starts AS (SELECT movie_id, rank, text, unnest(range(1, length(text) + 1)) AS i FROM names),
spans AS (SELECT *, unnest(range(1, length(text) - i + 2)) AS n FROM starts),
postings AS (SELECT DISTINCT substring(text, i, n) AS ngram, movie_id, rank FROM spans)
"""

ORACLES["ngrams_of_parts"] = f"""
WITH {_PART_POSTINGS}
SELECT ngram, movie_id, rank, row_number() OVER (PARTITION BY ngram ORDER BY rank DESC, movie_id) AS pos
FROM postings
"""

_TITLE_POSTINGS = f"""
names AS (SELECT movie_id, rank, {_stem("title")} AS text FROM cat),
starts AS (SELECT movie_id, rank, text, unnest(range(1, length(text) + 1)) AS i FROM names),
spans AS (SELECT *, unnest([1, 2, 3, 5]) AS n FROM starts),
postings AS (
  SELECT DISTINCT substring(text, i, n) AS ngram, movie_id, rank FROM spans WHERE i + n - 1 <= length(text))
"""

ORACLES["ngrams_distinct"] = f"""
WITH {_CATALOG}, {_TITLE_POSTINGS}
SELECT ngram, count(*) AS titles, max(rank) AS best FROM postings GROUP BY ngram
"""

ORACLES["ngrams_ranked"] = f"""
WITH {_CATALOG}, {_TITLE_POSTINGS}
SELECT ngram, movie_id, rank,
  row_number() OVER (PARTITION BY ngram ORDER BY rank DESC, movie_id) AS pos
FROM postings QUALIFY pos <= 6
"""

# --- search -------------------------------------------------------------------------------

_WORD_REQUESTS = f"""
q AS (SELECT DISTINCT unnest({_words(_stem("text"))}) AS input FROM benchmark)
"""

_TITLES = f"titles AS (SELECT movie_id, rank, {_stem('title')} AS text FROM cat)"

_ANSWER = """
  input, CAST(pos AS INTEGER) AS pos, b.movie_id, b.rank, cat.title, cat.local_cover, cat.director, cat.date
"""

_EXACT = f"""
WITH {_CATALOG}, {_TITLES}, {_WORD_REQUESTS},
best AS (
  SELECT input, movie_id, rank,
    row_number() OVER (PARTITION BY input ORDER BY rank DESC, movie_id) AS pos
  FROM q JOIN titles ON contains(text, input)
  WHERE strlen(input) + 1 <= 80
)
"""

ORACLES["search_exact"] = _EXACT + f"SELECT {_ANSWER} FROM best b JOIN cat USING (movie_id) WHERE pos <= 6"

ORACLES["search_detail"] = _EXACT + f"""
SELECT input, cat.movie_id, {_DETAIL} FROM best b JOIN cat USING (movie_id) WHERE pos = 1
"""


def _variants(source: str) -> str:
    """Variants of the texts ``input`` of a table, with their first visit."""
    return f"""
edits AS (SELECT input, length(input) AS size, unnest(range(0, length(input) * 55 + 1)) AS visit FROM {source}),
spots AS (SELECT *, size - (visit - 1) // 55 AS i, (visit - 1) % 55 AS k FROM edits WHERE visit > 0),
walked AS (
  SELECT input, input AS ngram, 0 AS visit FROM {source}
  UNION ALL
  SELECT input, substring(input, 1, i - 1)
    || CASE WHEN k = 54 THEN '' ELSE substring(' abcdefghijklmnopqrstuvwxyz', k // 2 + 1, 1) END
    || CASE WHEN k % 2 = 1 THEN substring(input, i) ELSE substring(input, i + 1) END, visit
  FROM spots),
variants AS (SELECT input, ngram, min(visit) AS visit FROM walked WHERE ngram <> '' GROUP BY ALL)
"""


ORACLES["fuzzy_variants"] = f"""
WITH {_WORD_REQUESTS}, {_variants("q")} SELECT input AS text, ngram, visit FROM variants
"""

_HITS = f"""
wanted AS (SELECT DISTINCT ngram, length(ngram) AS n FROM variants),
sizes AS (SELECT DISTINCT n FROM wanted),
starts AS (SELECT movie_id, text, unnest(range(1, length(text) + 1)) AS i FROM titles),
pieces AS (SELECT movie_id, substring(text, i, (SELECT max(n) FROM sizes)) AS piece FROM starts),
grams AS (SELECT movie_id, substring(piece, 1, n) AS ngram FROM pieces JOIN sizes ON n <= length(piece)),
found AS (SELECT DISTINCT movie_id, ngram FROM grams SEMI JOIN wanted USING (ngram)),
hits AS (
  SELECT input, movie_id, min(visit) AS visit FROM variants JOIN found USING (ngram) GROUP BY ALL),
ranked AS (SELECT hits.*, titles.rank FROM hits JOIN titles USING (movie_id))
"""

_FUZZY = f"WITH {_CATALOG}, {_TITLES}, {_WORD_REQUESTS}, {_variants('q')}, {_HITS}"

ORACLES["search_fuzzy"] = _FUZZY + f""",
best AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY rank DESC, movie_id) AS pos FROM ranked)
SELECT {_ANSWER} FROM best b JOIN cat USING (movie_id) WHERE pos <= 6
"""

ORACLES["search_discover"] = _FUZZY + f""",
counted AS (SELECT *, count(*) FILTER (visit = 0) OVER (PARTITION BY input) AS n_exact FROM ranked),
best AS (
  SELECT *, row_number() OVER (PARTITION BY input ORDER BY rank DESC, movie_id) AS pos
  FROM counted WHERE n_exact < 6 OR visit = 0)
SELECT {_ANSWER} FROM best b JOIN cat USING (movie_id) WHERE pos <= 6
"""

# Where a third of a word occurs, every text around it of up to two letters more or less is tried.
ORACLES["search_two_edits"] = f"""
WITH {_CATALOG}, {_TITLES}, {_WORD_REQUESTS},
wanted AS (SELECT input, length(input) AS n, length(input) // 3 AS third FROM q WHERE regexp_full_match(input, '[a-z]{{9,}}')),
parts AS (
  SELECT input, n, unnest([0, third, 2 * third]) AS before, unnest([third, third, n - 2 * third]) AS size FROM wanted),
keys AS (SELECT *, substring(input, before + 1, size) AS part FROM parts),
starts AS (
  SELECT movie_id, i, unnest((SELECT list(DISTINCT size) FROM parts)) AS size, text
  FROM (SELECT movie_id, text, unnest(range(1, length(text) + 1)) AS i FROM titles)),
met AS (
  SELECT DISTINCT input, n, movie_id, i - before AS start, substring(text, greatest(1, i - before - 2), n + 6) AS around,
    i - before - greatest(1, i - before - 2) AS lead
  FROM starts s JOIN keys k ON s.size = k.size AND substring(text, i, s.size) = k.part),
tried AS (
  SELECT input, movie_id, substring(around, f, l) AS x
  FROM (SELECT *, unnest(range(1, 6)) AS f FROM met), (SELECT unnest(range(-2, 3)) AS more), LATERAL (SELECT n + more AS l)),
hits AS (
  SELECT input, movie_id, min(levenshtein(input, x)) AS visit FROM tried
  WHERE levenshtein(input, x) <= 2 AND regexp_full_match(x, '[a-z ]*') GROUP BY ALL),
ranked AS (SELECT hits.*, titles.rank FROM hits JOIN titles USING (movie_id)),
counted AS (SELECT *, count(*) FILTER (visit = 0) OVER (PARTITION BY input) AS n_exact FROM ranked),
best AS (
  SELECT *, row_number() OVER (PARTITION BY input ORDER BY rank DESC, movie_id) AS pos
  FROM counted WHERE n_exact < 6 OR visit = 0)
SELECT {_ANSWER} FROM best b JOIN cat USING (movie_id) WHERE pos <= 6
"""


def _evicted(source: str) -> str:
    """Answers of the queue that gives up its best entry, from the hits of a table."""
    return f"""
placed AS (
  SELECT *, row_number() OVER (PARTITION BY input ORDER BY visit, rank DESC, movie_id) AS place,
    row_number() OVER (PARTITION BY input ORDER BY rank DESC, visit, movie_id) AS by_rank
  FROM {source}),
entered AS (
  SELECT *, max(rank) FILTER (place <= 6) OVER (PARTITION BY input) AS top_entered,
    max(rank) OVER (PARTITION BY input) AS top,
    row_number() OVER (PARTITION BY input, place <= 6 ORDER BY rank DESC, movie_id) AS entered_place
  FROM placed),
kept AS (
  SELECT * FROM entered
  WHERE CASE WHEN top > top_entered THEN (place <= 6 AND entered_place > 1) OR by_rank = 1 ELSE place <= 6 END),
best AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY rank DESC, movie_id) AS pos FROM kept)
SELECT {_ANSWER} FROM best b JOIN cat USING (movie_id)
"""


ORACLES["search_fuzzy_reference"] = _FUZZY + "," + _evicted("ranked")

ORACLES["discover_reference"] = _FUZZY + """,
counted AS (SELECT *, count(*) FILTER (visit = 0) OVER (PARTITION BY input) AS n_exact FROM ranked),
gated AS (SELECT input, movie_id, visit, rank FROM counted WHERE n_exact < 6 OR visit = 0),
""" + _evicted("gated")

ORACLES["search_saved_index"] = f"""
WITH {_PART_POSTINGS},
q AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS input FROM part), {_variants("q")},
hits AS (SELECT input, movie_id, rank, min(visit) AS visit FROM variants JOIN postings USING (ngram) GROUP BY ALL),
counted AS (SELECT *, count(*) FILTER (visit = 0) OVER (PARTITION BY input) AS n_exact FROM hits),
best AS (
  SELECT *, row_number() OVER (PARTITION BY input ORDER BY rank DESC, movie_id) AS pos
  FROM counted WHERE n_exact < 6 OR visit = 0)
SELECT input, pos, movie_id, rank, p_name AS title FROM best JOIN part ON p_partkey = movie_id WHERE pos <= 6
"""

# --- prediction ---------------------------------------------------------------------------

_MODEL = f"""
titled AS (
  SELECT rank, genre, nationalities,
    list_filter({_words(_stem("title"))}, lambda w: w NOT IN ({_STOP_WORDS})) AS words FROM cat),
shared AS (
  SELECT unnest(words) AS word, genre, nationalities,
    (rank + 600000) / 60000::DOUBLE / len(words) AS share FROM titled),
labelled AS (
  SELECT 'genre' AS label_kind, word, unnest(genre) AS class, share FROM shared
  UNION ALL SELECT 'nationality', word, unnest(nationalities), share FROM shared),
weights AS (SELECT label_kind, word, class, sum(share) AS weight FROM labelled GROUP BY ALL),
totals AS (SELECT label_kind, word, sum(weight) AS total FROM weights GROUP BY ALL),
model AS (
  SELECT label_kind, word, class, weight / total AS p
  FROM weights JOIN totals USING (label_kind, word) WHERE total <> 0)
"""

ORACLES["train_weights"] = f"""
WITH {_CATALOG}, {_MODEL} SELECT label_kind, word, class, CAST(weight AS FLOAT) AS weight FROM weights
"""

ORACLES["train_probs"] = f"""
WITH {_CATALOG}, {_MODEL} SELECT label_kind, word, class, CAST(p AS FLOAT) AS p FROM model
"""


def _predictions(source: str) -> str:
    """Ranked classes of the texts ``input`` of a table."""
    return f"""
usable AS (
  SELECT * FROM model WHERE word IN (SELECT word FROM model WHERE label_kind = 'genre')),
asked AS (
  SELECT input, unnest(list_filter({_words(_stem("input"))}, lambda w: w NOT IN ({_STOP_WORDS}))) AS word
  FROM {source} WHERE strlen(input) + 1 <= 80),
scores AS (
  SELECT input, label_kind, class, sum(p) AS score FROM asked JOIN usable USING (word) GROUP BY ALL),
probable AS (
  SELECT input, label_kind, class,
    round(score / sum(score) OVER (PARTITION BY input, label_kind), 9) AS p FROM scores),
predicted AS (
  SELECT *, row_number() OVER (PARTITION BY input, label_kind ORDER BY p DESC, class DESC) AS pos
  FROM probable),
kept AS (
  SELECT *, CAST(floor(round(p * 100, 6)) AS INTEGER) AS pct FROM predicted
  WHERE pos <= (CASE label_kind WHEN 'genre' THEN 4 ELSE 2 END) AND p > 0.01)
"""


_SPOKEN = "spoken AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS input FROM conversations)"

for _kind in ("genre", "nationality"):
    ORACLES[f"predict_{_kind}"] = f"""
WITH {_CATALOG}, {_MODEL}, {_SPOKEN}, {_predictions("spoken")}
SELECT input, pos, class, CAST(p AS FLOAT) AS p, pct FROM kept WHERE label_kind = '{_kind}'
"""

ORACLES["accuracy"] = f"""
WITH {_CATALOG}, {_MODEL},
truth AS (
  SELECT title AS input, count(*) AS n, arg_max(genre, movie_id) AS genre,
    arg_max(nationalities, movie_id) AS nationalities FROM dump GROUP BY title),
{_predictions("truth")},
first AS (SELECT input, label_kind, class FROM kept WHERE pos = 1),
judged AS (
  SELECT k.label_kind, t.n, f.class,
    CASE k.label_kind WHEN 'genre' THEN list_contains(t.genre, f.class)
      ELSE list_contains(t.nationalities, ' ' || f.class) END AS hit
  FROM truth t CROSS JOIN (VALUES ('genre'), ('nationality')) k(label_kind)
  LEFT JOIN first f ON f.input = t.input AND f.label_kind = k.label_kind)
SELECT label_kind, CAST(sum(CASE WHEN hit THEN n ELSE 0 END) AS DOUBLE) AS success,
  CAST(sum(CASE WHEN class IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS total,
  CAST(sum(CASE WHEN class IS NULL THEN n ELSE 0 END) AS BIGINT) AS errors,
  round(CAST(sum(CASE WHEN hit THEN n ELSE 0 END) AS DOUBLE)
    / sum(CASE WHEN class IS NOT NULL THEN n ELSE 0 END), 9) AS rate
FROM judged GROUP BY label_kind
"""

# --- statistics ---------------------------------------------------------------------------

ORACLES["value_counts"] = f"""
WITH {_DUMP}, v AS (SELECT unnest(genre) AS value FROM dump)
SELECT trim(value) AS value, count(*) AS count FROM v WHERE value <> '' GROUP BY ALL
"""

ORACLES["status_counts"] = f"""
WITH {_DUMP} SELECT trim(status) AS value, count(*) AS count FROM dump GROUP BY ALL
"""


def _top_and_others(counts: str) -> str:
    return f"""
counts AS ({counts}),
placed AS (SELECT *, row_number() OVER (ORDER BY count DESC, value) AS place FROM counts)
SELECT value, count, false AS is_other FROM placed WHERE place <= 10
UNION ALL
SELECT 'Autres', CAST(coalesce(sum(count), 0) AS BIGINT), true FROM placed WHERE place > 10
"""


ORACLES["top_n_others"] = "WITH " + _top_and_others(
    "SELECT trim(source) AS value, count(*) AS count FROM documents WHERE source <> '' GROUP BY ALL"
)

ORACLES["top_titles"] = f"WITH {_LINES}, " + _top_and_others(
    "SELECT regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS value, count(*) AS count"
    " FROM lines WHERE title <> '' GROUP BY ALL"
)

# Neighbours in the order of all suffixes: the beginnings a suffix shares with the one before are counted there.
_STEPS = [2**n for n in range(15, -1, -1)]
_LCP = ", ".join(
    f"l{n} AS (SELECT a, b, n, shared + CASE WHEN least(n, length(b)) >= shared + {n} AND substring(a, shared + 1, {n}) "
    f"= substring(b, shared + 1, {n}) THEN {n} ELSE 0 END AS shared FROM {'pairs' if n == _STEPS[0] else f'l{2 * n}'})"
    for n in _STEPS
)
_NGRAM_LENGTHS = f"""
texts AS (SELECT DISTINCT text FROM (SELECT {_stem("title")} AS text FROM lines) WHERE text <> ''),
suffixes AS (SELECT substring(text, unnest(range(1, length(text) + 1))) AS a FROM texts),
pairs AS (SELECT a, length(a) AS n, coalesce(lag(a) OVER (ORDER BY a), '') AS b, 0 AS shared FROM suffixes),
{_LCP},
changes AS (
  SELECT length, sum(n) AS n
  FROM (SELECT n AS length, 1 AS n FROM l1 UNION ALL SELECT shared, -1 FROM l1 WHERE shared > 0) GROUP BY length),
lengths AS (SELECT length, CAST(sum(n) OVER (ORDER BY length DESC) AS BIGINT) AS count FROM changes)
"""

ORACLES["ngram_length_hist"] = f"WITH {_LINES}, {_NGRAM_LENGTHS} SELECT length, count FROM lengths"

ORACLES["catalog_counts"] = f"""
WITH {_LINES}, {_NGRAM_LENGTHS}
SELECT (SELECT count(*) FROM lines) AS movies, CAST(sum(count) AS BIGINT) AS ngrams FROM lengths
"""

ORACLES["partition_rows"] = "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(16 AS BIGINT) AS partitions FROM orders"

ORACLES["observed_rows"] = f"""
WITH {_LINES}
SELECT count(*) AS rows_before, count(*) AS rows_after, count(*) AS rows_written, 16 AS partitions FROM lines
"""

_TITLE_WORDS = f"{_LINES}, w AS (SELECT unnest({_words(_stem('title'))}) AS word FROM lines)"

ORACLES["sketched_distinct"] = f"""
WITH {_TITLE_WORDS}
SELECT count(DISTINCT word) AS exact, count(*) AS words, true AS in_bounds, true AS as_whole FROM w
"""

ORACLES["heavy_words"] = f"""
WITH {_TITLE_WORDS}
SELECT word AS value, count(*) AS count FROM w GROUP BY word HAVING count(*) * 500 > (SELECT count(*) FROM w)
"""

ORACLES["values_round_trip"] = """
SELECT trim(c_mktsegment) AS value, count(*) AS count FROM customer
WHERE c_mktsegment <> '' GROUP BY ALL
"""

# --- crawl and extraction -----------------------------------------------------------------

ORACLES["seed_pages"] = f"""
SELECT page_no, '{_SITE}/films/?page=' || page_no AS url,
  CAST(coalesce(len(string_split(text, chr(10))), -1) AS INTEGER) AS films
FROM (SELECT unnest(range(1, (SELECT count(*) FROM documents) + 1)) AS page_no)
LEFT JOIN documents ON doc_id + 1 = page_no
"""

_UNESCAPED = "replace(replace(replace(replace({}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"

ORACLES["page_links"] = f"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links FROM pages)
SELECT page_id, place, {_UNESCAPED.format("url")} AS url
FROM (SELECT page_id, unnest(links) AS url, unnest(range(len(links))) AS place FROM p)
"""

ORACLES["page_ranks"] = """
SELECT page_id,
  coalesce(TRY_CAST(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS FLOAT), CAST(-1 AS FLOAT)) AS rank
FROM pages
"""

ORACLES["page_titles"] = """
SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
  regexp_extract(html, '<html lang="(..)"', 1) AS lang,
  len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links
FROM pages
"""

_RECORDS = _LINES + f""",
films AS (
  SELECT {_FILM_URL} AS url, mark % 29 = 0 AS failed,
    CASE WHEN mark % 3 = 0 THEN 'MISSING TRAILER' WHEN mark % 17 = 0 THEN 'NO SYNOPSIS'
      WHEN mark % 13 = 0 THEN 'NO RELEASE DATE' WHEN mark % 5 = 0 THEN 'UNRELEASED'
      ELSE 'RELEASED' END AS status,
    CAST(CASE WHEN mark % 5 = 0 THEN -1 ELSE 1 + mark % 3 END AS FLOAT) AS hours,
    CAST(CASE WHEN mark % 5 = 0 THEN -1 ELSE mark % 60 END AS FLOAT) AS minutes,
    title, CASE WHEN mark % 13 = 0 THEN '' ELSE 'day ' || mark % 30 END AS date,
    '/cover/' || movie_id AS cover, 'Director ' || mark % 211 AS director,
    source || '|' || CASE WHEN size > 200 THEN 'long' ELSE 'short' END AS genre,
    ' ' || lang AS nationalities,
    CAST(CASE WHEN mark % 7 = 0 THEN -1 ELSE (size % 50) / 10.0::DOUBLE END AS FLOAT) AS score_press,
    CAST(CASE WHEN mark % 7 = 0 THEN -1 ELSE size % 500 END AS FLOAT) AS reviews_press,
    CAST(CASE WHEN mark % 11 = 0 THEN -1 ELSE (size % 50) / 10.0::DOUBLE END AS FLOAT) AS score_viewers,
    CAST(CASE WHEN mark % 11 = 0 THEN -1 ELSE size % 500 END AS FLOAT) AS reviews_viewers,
    '/shot/' || movie_id AS pictures, lang || '|-|' || source AS actors,
    CASE WHEN mark % 17 = 0 THEN '' ELSE 'Line ' || line_no END AS synopsis,
    '<div class="ovw-synopsis-info"><br/>' || source || '</div>' AS misc,
    CASE WHEN mark % 3 = 0 THEN ''
      ELSE 'http://media/x_' || CASE WHEN mark % 2 = 1 THEN 'hd' ELSE 'sd' END || '_' || movie_id || '.mp4'
      END AS trailer,
    CAST((doc_id * 7) % 1000000 + line_no AS FLOAT) AS rank, mark
  FROM lines)
"""

ORACLES["page_records"] = f"WITH {_RECORDS} SELECT * EXCLUDE (failed, mark) FROM films WHERE NOT failed"
ORACLES["page_failures"] = f"WITH {_RECORDS} SELECT url FROM films WHERE failed"
ORACLES["page_status"] = f"""
WITH {_RECORDS} SELECT status, count(*) AS count FROM films WHERE NOT failed GROUP BY status
"""
ORACLES["trailer_url"] = f"WITH {_RECORDS} SELECT url, trailer FROM films WHERE NOT failed"
ORACLES["crawl_records"] = f"""
WITH {_RECORDS} SELECT url, status, title, trailer, rank FROM films WHERE NOT failed
"""
ORACLES["stream_extract"] = ORACLES["crawl_records"]

_NOTE = "replace(CAST((size % 50) / 10.0::DOUBLE AS VARCHAR), '.', ',')"
#: Field, place, value and which pages have it.
_PAGE_VALUES = [
    ("score_press", 0, _NOTE, "mark % 7 <> 0"),
    ("reviews_press", 0, "CAST(size % 500 AS VARCHAR)", "mark % 7 <> 0"),
    ("score_viewers", 0, _NOTE, "mark % 11 <> 0"),
    ("reviews_viewers", 0, "CAST(size % 500 AS VARCHAR)", "mark % 11 <> 0"),
    ("date", 0, "'day ' || mark % 30", "mark % 13 <> 0"),
    ("synopsis", 0, "'Line ' || line_no", "mark % 17 <> 0"),
    ("title", 0, "nullif(title, '')", "mark % 29 <> 0"),
    ("cover", 0, "'/cover/' || movie_id", "true"),
    ("director", 0, "'Director ' || mark % 211", "true"),
    ("genre", 0, "source", "true"),
    ("genre", 1, "CASE WHEN size > 200 THEN 'long' ELSE 'short' END", "true"),
    ("nationalities", 0, "' ' || lang", "true"),
    ("pictures", 0, "'/shot/' || movie_id", "true"),
    ("actors", 0, "lang", "true"),
    ("actors", 1, "NULL", "true"),
    ("actors", 2, "source", "true"),
    ("misc", 0, "'<div class=\"ovw-synopsis-info\"><br/>' || source || '</div>'", "true"),
    ("trailer_link", 0, "'/video/' || movie_id", "mark % 3 <> 0"),
]
ORACLES["page_values"] = f"WITH {_LINES} " + " UNION ALL ".join(
    f"SELECT {_FILM_URL} AS url, '{field}' AS field, CAST({place} AS INTEGER) AS place, {value} AS value FROM lines WHERE {has}"
    for field, place, value, has in _PAGE_VALUES
)

ORACLES["crawl_events"] = f"""
WITH {_RECORDS},
tagged AS (SELECT unnest([
  CASE WHEN mark % 5 = 0 THEN 'UNRELEASED_MOVIES' END,
  CASE WHEN mark % 13 = 0 THEN 'NO RELEASE DATE' END,
  CASE WHEN mark % 17 = 0 THEN 'NO SYNOPSIS' END,
  CASE WHEN mark % 3 = 0 AND NOT failed THEN 'FAILED_TRAILERS' END,
  CASE WHEN failed THEN 'FAILED_MOVIES' ELSE 'MOVIES' END]) AS tag FROM films)
SELECT tag, count(*) AS count FROM tagged WHERE tag IS NOT NULL GROUP BY tag
UNION ALL SELECT 'DIRECTORIES', count(*) FROM documents
"""

ORACLES["merged_dump"] = f"""
WITH {_DUMP}
SELECT count(*) AS records, CAST(sum(movie_id % 1000) AS BIGINT) AS ids, CAST(0 AS BIGINT) AS out_of_order,
  CAST(0 AS BIGINT) AS broken FROM dump
"""

ORACLES["dump_quarantine"] = f"""
WITH {_DUMP}
SELECT CASE WHEN movie_id % 5 = 0 THEN 'broken' WHEN movie_id % 7 = 0 THEN 'untitled' ELSE 'kept' END AS kind,
  count(*) AS lines FROM dump GROUP BY ALL
"""

# --- requests and streams -----------------------------------------------------------------

_DISCOVER = _FUZZY + """,
counted AS (SELECT *, count(*) FILTER (visit = 0) OVER (PARTITION BY input) AS n_exact FROM ranked),
best AS (
  SELECT *, row_number() OVER (PARTITION BY input ORDER BY rank DESC, movie_id) AS pos
  FROM counted WHERE n_exact < 6 OR visit = 0),
answers AS (
  SELECT input, pos, title, local_cover, director, date FROM best b JOIN cat USING (movie_id) WHERE pos <= 6)
"""

ORACLES["discover_lines"] = _DISCOVER + """
SELECT input, pos, title, local_cover AS cover, director || ' (' || date || ')' AS director_date FROM answers
"""

_JSON_DETAIL = """
to_json({'actors': actors, 'cover': local_cover, 'date': date, 'director': director, 'genre': genre,
  'hours': hours, 'minutes': minutes, 'misc': misc, 'nationalities': nationalities, 'pictures': pictures,
  'reviews_viewers': reviews_viewers, 'score_viewers': CAST(CAST(score_viewers AS VARCHAR) AS DOUBLE), 'status': status,
  'synopsis': synopsis, 'title': title, 'trailer': trailer})
"""


def _labels(kind: str) -> str:
    return f"""(SELECT '[' || string_agg('{{' || to_json(class) || ':' || pct || '}}', ',' ORDER BY pos) || ']'
      FROM kept WHERE kept.input = s.input AND label_kind = '{kind}')"""


ORACLES["request_dispatch"] = _DISCOVER + f""",
{_MODEL}, {_SPOKEN}, {_predictions("spoken")},
detail AS (
  SELECT input, movie_id FROM ranked WHERE visit = 0
  QUALIFY row_number() OVER (PARTITION BY input ORDER BY rank DESC, movie_id) = 1),
analysed AS (
  SELECT input, '{{"genre":' || coalesce({_labels("genre")}, 'null') || ',"nationality":'
    || coalesce({_labels("nationality")}, 'null') || ',"query":' || to_json(input) || '}}' AS response
  FROM spoken s WHERE strlen(input) + 1 <= 80)
SELECT 'd' AS feature, input, coalesce(string_agg(
    title || '§' || local_cover || '§' || director || '§' || date || chr(10), '' ORDER BY pos), '') AS response
FROM q LEFT JOIN answers USING (input) GROUP BY input
UNION ALL
SELECT 'f', q.input, coalesce(CAST({_JSON_DETAIL} AS VARCHAR), '')
FROM q LEFT JOIN detail USING (input) LEFT JOIN cat USING (movie_id) WHERE movie_id IS NOT NULL
UNION ALL
SELECT 'f', q.input, '' FROM q ANTI JOIN detail USING (input)
UNION ALL
SELECT 'a', input, coalesce(response, '') FROM spoken LEFT JOIN analysed USING (input)
UNION ALL
SELECT 'x', input, '' FROM spoken
"""
ORACLES["stream_requests"] = ORACLES["request_dispatch"]

ORACLES["telemetry_counts"] = """
SELECT date_trunc('hour', ts) AS window_start, event_type AS tag, count(*) AS count
FROM events GROUP BY ALL
"""
ORACLES["stream_telemetry"] = ORACLES["telemetry_counts"]

ORACLES["search_stored_titles"] = ORACLES["search_discover"]
ORACLES["search_from_index"] = ORACLES["search_discover"]
ORACLES["index_add"] = ORACLES["search_exact"]
ORACLES["predict_stored_model"] = ORACLES["predict_genre"]
