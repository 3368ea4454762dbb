"""Results depend on them, so they are stated once, here."""

# Words ignored by the label predictor.
STOP_WORDS = [
    "and", "the", "of", "de", "l", "l'", "avec", "for", "pour", "in", "sur", "on", "under",
    "sous", "la", "le", "les", "all", "with", "a", "un", "une", "to", "an", "from",
]

# Letters tried by an edit, in the order in which they are tried.
EDIT_ALPHABET = " abcdefghijklmnopqrstuvwxyz"

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ASCII_SPACE = " \t\n\x0b\f\r"

# Popularity rank and training weight.
NO_TRAILER_PENALTY = 600000
REVIEW_FACTOR = 10
SCORE_FACTOR = 10000
WEIGHT_OFFSET = 600000
WEIGHT_SCALE = 60000

UNKNOWN_DATE = "Date de sortie inconnue"
OTHERS = "Autres"
FIELD_SEPARATOR = "§"
DISPLAY_SEPARATOR = "&nbsp;&nbsp|&nbsp;&nbsp;"

# Requests.
MAX_MESSAGE_BYTES = 80
SEARCH_RESULTS = 6
SEARCH_DISTANCE = 1
GENRE_RESULTS = 4
NATIONALITY_RESULTS = 2
MIN_PROBABILITY = 0.01

# Crawl frontier and page patterns.
LISTING_PAGES = 7085
LISTING_PATH = "/films/?page="
LISTING_LINK_CLASS = "meta-title-link"
DURATION_PATTERN = r"\(([0-9]+)h ([0-9]+)min\)"
TRAILER_HD_PATTERN = r"([.\\/0-9a-zA-Z_]+hd[/0-9a-zA-Z_]+\.mp4)"
TRAILER_ANY_PATTERN = r"([.\\/0-9a-zA-Z_]+[^k]\.mp4)"
