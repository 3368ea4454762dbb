"""Main text of web pages by a maximum-scoring run of blocks (operator 3).

A page is read once, into blocks: the text between block-level tags, with the tags before it. Words score positive,
by how likely words in such surroundings (elements around, their class and id names, share of linked words) are
content; tags score negative, by how often such tags stand outside of content. Both kinds of weight are counted
on labelled pages: those that mark their content with exactly one ``article`` or ``main`` element. These two
elements themselves get no weight, so the weights also serve pages without them. A linear scan finds the run of
blocks with the highest sum: the content region. Blocks inside it that stand in a menu, form, notice, advert or
among reader comments are left out; everything else in it is kept whole, in page order. An element is known as one of
these by its kind, or by a class, id or role that is one of ``APART_NAMES`` as a whole; as part of a longer name such a
word only lowers the weight of words. Names of the page, of its body and of the content itself say nothing, and names
around the content do not set it apart.

Weights are fitted on about ``SAMPLE`` labelled pages, those with the smallest hash of id and address, for the
``FEATURES`` most frequent features; a prior of a few pseudo-counts speaks for elements and names that no labelled page
has, or too few.

Defined results: null, empty or text-free pages give an empty text. Markup may be cut off or wrongly nested. Equal
rows give equal results; an empty table gives an empty result; other columns are carried along by ``extracted``, a
column named like an added one is replaced.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import batches

SAMPLE = 4_000
FEATURES = 20_000
# No single feature decides: most that a log ratio may say.
LIMIT = 2.5

# Element names of the HTML standard, in groups.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
# Left out with what they hold; without an end tag, those of the first group take the rest of the page, as in browsers.
SKIPPED_TO_END = "script|style|title|textarea"
SKIPPED = "noscript|template|svg|math|iframe|object|canvas|audio|video|select|button"
CONTENT = {"article", "main"}
APART = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
# Words in class, id and role names that speak against content.
APART_NAMES = set(
    "ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments complementary consent "
    "cookie cookies copyright disclaimer disqus footer gdpr legal masthead menu modal nav navbar navigation newsletter "
    "notice overlay pager pagination popup promo promoted promotion related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({SKIPPED_TO_END})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    # a quotation mark begins a value only after the equals sign
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?/][^>]*>",
    re.S | re.I,
)
_CLOSED = re.compile(rf"-->\Z|</(?:{SKIPPED_TO_END})\s*>\Z|\A<[!?/](?!--)", re.I)
_SKIPPED = set(SKIPPED.split("|"))
_SKIPPED_END = re.compile(rf"</({SKIPPED})\s*>", re.I)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    tags: list[str]
    around: frozenset[str]
    apart: bool
    inside: bool

    def features(self) -> list[str]:
        share = [] if 0 < self.linked * 2 <= self.words else ["links all" if self.linked else "links no"]
        return [*self.around, *share]


@dataclass(slots=True)
class _Open:
    tag: str
    around: frozenset[str]
    apart: bool
    inside: bool
    link: bool
    named: bool = False


def blocks(page: str) -> list[Block]:
    """The blocks of a page with text, in page order."""
    out: list[Block] = []
    stack = [_Open("", frozenset(), False, False, False)]
    chunks: list[str] = []
    tags: list[str] = []
    linked: list[str] = []
    home = stack[0]

    def flush() -> None:
        nonlocal tags
        if chunks:
            text = " ".join(html.unescape("".join(chunks)).split())
            if text:
                n = text.count(" ") + 1
                link = len(html.unescape(" ".join(linked)).split())
                out.append(Block(text, n, min(link, n), tags, home.around, home.apart or home.named, home.inside))
                tags = []
            chunks.clear()
            linked.clear()

    def add(text: str) -> None:
        nonlocal home
        if not text:
            return
        if not chunks:
            home = stack[-1]
        chunks.append(text)
        if stack[-1].link:
            linked.append(text)

    ends: dict[str, list[tuple[int, int]]] = {}
    for end in _SKIPPED_END.finditer(page):
        ends.setdefault(end.group(1).lower(), []).append(end.span())
    at, last = 0, page.rfind(">") + 1  # no tag ends beyond
    while token := _TOKEN.search(page, at, last):
        add(page[at : token.start()])
        at = token.end()
        name = token.group(3)
        if name is None:
            if at == last and not _CLOSED.search(token.group()):
                at = len(page)  # a comment or script without end
            continue
        name = name.lower()
        if name in _SKIPPED and not token.group(2):
            later = ends.get(name, [])
            following = bisect_left(later, (at, 0))
            if not token.group(4).endswith("/") and following < len(later):
                at = later[following][1]
            continue
        if name == "br":
            chunks and chunks.append(" ")
            continue
        block = name not in INLINE
        if block:
            flush()
        if token.group(2):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE and not block:
                    break
        elif name not in VOID:
            tags.append(name)
            if block and name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") or block and stack[-1].tag == "p":
                _close(stack, name)
            stack.append(_opened(stack[-1], name, token.group(4)))
    add(page[at:].split("<!--")[0])
    flush()
    return out


def _close(stack: list[_Open], name: str) -> None:
    """Elements that end without an end tag: a paragraph at any block, an item or cell at the next one."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in ("p", name):
            del stack[i:]
            return
        if stack[i].tag not in INLINE:
            return


def _opened(parent: _Open, name: str, attributes: str) -> _Open:
    inside = parent.inside or name in CONTENT
    around, apart = parent.around, parent.apart
    # The header of the content itself holds its headline.
    apart = apart or (name in APART and not (name == "header" and inside))
    named = parent.named and (parent.inside or name not in CONTENT)
    whole_page = name in ("html", "head", "body")
    if attributes and "=" in attributes and not whole_page and (name not in CONTENT or parent.inside):
        names = [n for m in _NAMES.finditer(attributes) for n in (m[2] or m[3] or m[4] or "").lower().split()]
        words = {f"name {w}" for n in names for w in _WORD.findall(n)}
        named = named or not APART_NAMES.isdisjoint(names)
        if not words <= around:
            around = around | words
    if name not in CONTENT and name not in INLINE and not whole_page and f"in {name}" not in around:
        around = around | {f"in {name}"}
    return _Open(name, around, apart, inside, parent.link or name == "a", named)


@dataclass
class Weights:
    """Log ratios by feature and the share of outside places by tag."""

    ratio: dict[str, float] = field(default_factory=dict)
    outside: dict[str, float] = field(default_factory=dict)
    base: float = 2.0
    away: frozenset[str] = frozenset()

    def is_apart(self, block: Block) -> bool:
        """By its elements and names, or by a name that labelled pages have outside of content only."""
        return block.apart or not self.away.isdisjoint(block.around)

    def word(self, block: Block) -> float:
        """How likely the words of a block are content, 0 to 1."""
        total = self.base + sum(self.ratio.get(f, 0.0) for f in block.features())
        if self.is_apart(block):
            total -= 8.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    def tags(self, block: Block) -> float:
        return sum(self.outside.get(t, 0.5) for t in block.tags)


def region(scores: list[tuple[float, float]]) -> tuple[int, int]:
    """First and past-the-last index of the run with the highest sum, the earliest of equals.

    Each block comes as (score of the tags before it, score of its words); a run begins with words.
    """
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, (tags, words) in enumerate(scores):
        if total + tags <= 0:
            total, start = 0.0, i
        else:
            total += tags
        total += words
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: Weights) -> str:
    found = blocks(page or "")
    first, past = region([(-weights.tags(b), b.words * weights.word(b)) for b in found])
    return " ".join(b.text for b in found[first:past] if not weights.is_apart(b))


# Pseudo-counts (inside, outside) for what labelled pages may lack.
PRIOR = {
    "in nav": (0, 20), "in footer": (0, 20), "in aside": (0, 20), "in form": (0, 20), "in p": (20, 4), "in h1": (6, 2),
    "in h2": (6, 2), "in blockquote": (6, 2), "in pre": (6, 2), "links all": (1, 20), "links no": (20, 10),
    **{f"name {w}": (0, 20) for w in APART_NAMES},
}
#: Words outside of content, and none in it, from which on a name is known to be outside.
AWAY = 200


def fit(counts: list[tuple[str, int, int]]) -> Weights:
    """From (feature, words inside, words outside) and (``tag`` + name, times inside, times outside)."""
    table = {name: (float(i), float(o)) for name, i, o in counts}
    away = frozenset(n for n, (i, o) in table.items() if n.startswith("name ") and not i and o >= AWAY)
    words = [table.pop("all", (0.0, 0.0))]
    inside, outside = words[0]
    for name, (i, o) in PRIOR.items():
        have = table.get(name, (0.0, 0.0))
        table[name] = have[0] + i, have[1] + o
    inside, outside = inside + 100, outside + 100
    weights = Weights(base=math.log(inside / outside), away=away)
    for name, (i, o) in table.items():
        if name.startswith("tag "):
            weights.outside[name[4:]] = 0.02 + (o + 0.5) / (i + o + 1)
        else:
            ratio = math.log((i + 1) / (inside + 2)) - math.log((o + 1) / (outside + 2))
            weights.ratio[name] = max(-LIMIT, min(LIMIT, ratio))
    return weights


def labelled(found: list[Block], page: str) -> bool:
    marks = re.findall(r"<(?:article|main)\b", page, re.I)
    return len(marks) == 1 and any(b.inside for b in found)


def train(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from the labelled pages with the smallest hashes."""
    marked = pages.filter(F.col("html").rlike("(?i)<(?:article|main)\\b")).withColumn("_hash", F.xxhash64("page_id", "url"))
    last = marked.select("_hash").orderBy("_hash").limit(sample).agg(F.max("_hash")).first()[0]
    if last is None:
        return fit([])

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches(frames):
            for page in batch.column(0).to_pylist():
                found = blocks(page)
                if not labelled(found, page):
                    continue
                for b in found:
                    side = b.inside and not b.apart
                    counts["all", side] += b.words
                    for f in b.features():
                        counts[f, side] += b.words
                    for t in b.tags:
                        counts[f"tag {t}", side] += 1
        names = sorted({n for n, _ in counts})
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[n, True] for n in names], pa.int64()), pa.array([counts[n, False] for n in names], pa.int64())],
            ["feature", "inside", "outside"],
        )

    sums = (
        marked.filter(F.col("_hash") <= last)
        .select("html")
        .mapInArrow(work, "feature string, inside long, outside long")
        .groupBy("feature")
        .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        .orderBy(F.desc(F.col("inside") + F.col("outside")), "feature")
        .limit(FEATURES)
    )
    return fit([tuple(r) for r in sums.collect()])


def extracted(pages: DataFrame, weights: Weights) -> DataFrame:
    """``pages`` with ``text``."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    kept = pages.drop("text")
    at = kept.columns.index("html")
    names = [*kept.columns, "text"]

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        for batch in batches(frames):
            texts = [main_text(p.as_py(), tool) for p in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return kept.mapInArrow(work, kept.withColumn("text", F.lit("")).schema)
