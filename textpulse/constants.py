"""Fixed values the results depend on.

Everything in this module is data, not logic: label lists, lookup tables,
thresholds and regex character classes. Operators and the oracle SQL are both
generated from these values so the two sides can never drift apart.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the analysed pipeline for results to agree)
# ---------------------------------------------------------------------------

# Eight basic emotions, in output order; this order is also the tie-break
# order for every "dominant emotion" column.
EMOTIONS = ["anger", "anticipation", "disgust", "fear",
            "joy", "sadness", "surprise", "trust"]

# Forum -> expected language; any other forum maps to "unknown".
FORUM_LANG = {
    "etudiants": "fr",
    "college": "en",
    "CollegeRant": "en",
    "csMajors": "en",
    "Student": "en",
    "Students": "en",
}

# English contractions, applied in this order, case-insensitive, plain
# substring patterns (no word boundaries), replacement always lower-case.
CONTRACTIONS = [
    ("won't", "will not"),
    ("can't", "cannot"),
    ("n't", " not"),
    ("'re", " are"),
    ("shan't", "shall not"),
    ("'s", " is"),
    ("'d", " would"),
    ("'ll", " will"),
    ("'ve", " have"),
    ("'m", " am"),
    ("'cause", "because"),
    ("y'all", "you all"),
    ("gonna", "going to"),
    ("wanna", "want to"),
    ("gotta", "got to"),
    ("kinda", "kind of"),
    ("sorta", "sort of"),
    ("dunno", "do not know"),
    ("lemme", "let me"),
    ("gimme", "give me"),
    ("tryna", "trying to"),
]

MIN_TOKENS = 5

# Sentiment model labels -> unified class. Unknown labels count as neutral.
STAR_LABELS = {
    "1 star": "negative",
    "2 stars": "negative",
    "3 stars": "neutral",
    "4 stars": "positive",
    "5 stars": "positive",
}
THREE_CLASS_LABELS = {
    "negative": "negative",
    "neutral": "neutral",
    "positive": "positive",
}
# model_key -> label map. "fr" posts go to the 5-star model, everything
# else (en, other, unknown, null) to the 3-class model.
SENTIMENT_LABEL_MAPS = {"fr": STAR_LABELS, "en": THREE_CLASS_LABELS}
# Argmax tie order for the sentiment label.
SENTIMENT_CLASSES = ["positive", "neutral", "negative"]

# Emotion-model labels -> basic emotion. "neutral" and unlisted labels are
# ignored (they do not enter the normalising total).
MODEL_LABEL_TO_EMOTION = {
    "anger": "anger",
    "annoyance": "anger",
    "disapproval": "anger",
    "disgust": "disgust",
    "fear": "fear",
    "nervousness": "fear",
    "joy": "joy",
    "amusement": "joy",
    "excitement": "joy",
    "optimism": "anticipation",
    "anticipation": "anticipation",
    "surprise": "surprise",
    "realization": "surprise",
    "sadness": "sadness",
    "grief": "sadness",
    "disappointment": "sadness",
    "remorse": "sadness",
    "trust": "trust",
    "admiration": "trust",
    "approval": "trust",
    "caring": "trust",
    "curiosity": "anticipation",
    "desire": "anticipation",
    "love": "joy",
    "pride": "joy",
    "relief": "joy",
    "confusion": "surprise",
}

# Blend of lexicon and model emotion scores.
LEXICON_WEIGHT = 0.30
MODEL_WEIGHT = 0.70

# distress = (fear + sadness + 0.5 * anger) / 2.5
DISTRESS_WEIGHTS = {"fear": 1.0, "sadness": 1.0, "anger": 0.5}
DISTRESS_DIVISOR = 2.5
# Right-closed bins, the first one also closed on the left:
# [0, .2] low, (.2, .4] moderate, (.4, .6] high, (.6, 1.01] severe.
DISTRESS_EDGES = [0.0, 0.2, 0.4, 0.6, 1.01]
DISTRESS_LEVELS = ["low", "moderate", "high", "severe"]
# "high distress" share in the aggregates is score >= 0.4 (inclusive).
HIGH_DISTRESS_THRESHOLD = 0.4

# Academic season of a month, and the season display order.
SEASON_OF_MONTH = {
    1: "hiver", 2: "hiver",
    3: "printemps", 4: "printemps",
    5: "examens",
    6: "ete", 7: "ete", 8: "ete",
    9: "rentree",
    10: "automne", 11: "automne",
    12: "examens",
}
SEASON_ORDER = ["rentree", "automne", "hiver", "printemps", "examens", "ete"]

# French display labels for months and weekdays (chart datasets).
MONTH_LABELS_FR = ["Jan", "Fév", "Mar", "Avr", "Mai", "Jun",
                   "Jul", "Aoû", "Sep", "Oct", "Nov", "Déc"]
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday",
                 "Friday", "Saturday", "Sunday"]
WEEKDAY_LABELS_FR = ["Lun", "Mar", "Mer", "Jeu", "Ven", "Sam", "Dim"]

# Raw export names, in ingest order.
EXPORT_NAMES = [
    "posts_of_college_new", "posts_of_collegerant_new", "posts_of_csMajors_new",
    "posts_of_etudiants_new", "posts_of_Student_new", "posts_of_Students_new",
]

# Histogram bin counts.
TOKEN_HIST_BINS = 50
SCORE_HIST_BINS = 40
DISTRESS_HIST_BINS = 50

# Excerpt length and top-k sizes.
EXCERPT_CHARS = 80
TOP_DISTRESS_POSTS = 10
TOPIC_LABEL_WORDS = 3
TOPIC_REPORT_WORDS = 10

# Topic model defaults.
NR_TOPICS = 12
MIN_TOPIC_SIZE = 20
TOPIC_SEED = 42
REDUCED_DIMS = 5
EMBEDDING_DIMS = 64
DENSITY_RADIUS = 0.15    # of unit vectors in the reduced space
DENSITY_MIN_POINTS = 10
NGRAM_MIN_DF = 5
NGRAM_MAX_DF = 0.85

# Reproducible sampling seed.
SAMPLE_SEED = 42

# ---------------------------------------------------------------------------
# Regex character classes (written so Java regex and RE2 read them the same)
# ---------------------------------------------------------------------------

# Unicode white space as understood by Python's str.split() / \s.
WS_CLASS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}"
            r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = "[" + WS_CLASS + "]"
WS_NOT_SPACE = "[" + WS_CLASS.replace(" ", "") + "]"
NOT_WS = "[^" + WS_CLASS + "]"
# The same white space as literal characters, minus the plain space, for
# character-level translation (cheaper than a regex class scan).
WS_CHARS_NOT_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
                      + "".join(chr(c) for c in range(0x2000, 0x200B))
                      + "\u2028\u2029\u202f\u205f\u3000")
# Ranges around the white space that the JVM's \\s doesn't know.
WS_HINT = r"[\x{1C}-\x{1F}\x{85}-\x{A0}\x{1680}-\x{3000}]"
# Characters whose presence means a value may hold an emoji. One wide range is
# tested first: nothing else is tested for a plain letter.
EMOJI_HINT = (r"[\x{A9}-\x{E007F}&&[\x{A9}\x{AE}\x{2000}-\x{3299}\x{FE0F}\x{1F000}-\x{1FAFF}"
              r"\x{E0020}-\x{E007F}]]")
# Word character in the sense of Python's Unicode \w.
WORD_CLASS = r"\p{L}\p{N}_"
# Token pattern: letters, marks, digits, underscore.
TOKEN_PATTERN = r"[\p{L}\p{M}\p{N}_]+"
# Its tokens that are not numbers and have two characters in lower case (U+0130
# has two by itself). ASCII is named first: the JVM tests it by a bit table.
CONTENT_TOKEN_JVM = (r"(?!\p{N}+(?![a-zA-Z0-9_\p{L}\p{M}\p{N}]))"
                     r"(?:[a-zA-Z0-9_\p{L}\p{M}\p{N}]{2,}|\x{130})")

# Code points with the Unicode property Emoji (emoji-data, version 16; digits,
# "#" and "*" count only in keycaps).
EMOJI_RANGES = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0
25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642
2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB
26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705
2708-270D 270F 2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797
27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F
1F18E 1F191-1F19A 1F1E6-1F1FF 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393
1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570
1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3
1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9
1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FA89
1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 1FAF0-1FAF8
""".split()


def emoji_pattern() -> str:
    ends = [r.split("-") for r in EMOJI_RANGES]
    return "[" + "".join("-".join(r"\x{%s}" % x for x in e) for e in ends) + "]"


# A keycap is a digit, "#" or "*" with U+20E3. An emoji is one code point, what
# modifies it (variation selector, tags), and further emoji joined to it by
# U+200D; a joiner elsewhere belongs to its word.
KEYCAP = r"[0-9#*]\x{FE0F}?\x{20E3}"
EMOJI_ONE = emoji_pattern() + r"[\x{FE0F}\x{E0020}-\x{E007F}]*"
EMOJI_SEQUENCE = EMOJI_ONE + r"(?:\x{200D}" + EMOJI_ONE + ")*"
EMOJI = KEYCAP + "|" + EMOJI_SEQUENCE
# The same sequence for the JVM, which tests a class's ranges one by one: most
# characters fail the two wide ranges that every emoji is in.
EMOJI_SEQUENCE_JVM = r"[\x{A9}-\x{1FAFF}&&[^\x{AF}-\x{1FFF}]&&" + emoji_pattern() + "]" + EMOJI_SEQUENCE.removeprefix(emoji_pattern())
EMOJI_JVM = KEYCAP + "|" + EMOJI_SEQUENCE_JVM
# Ranges around every code point that NFC changes, reorders or may join to the
# one before it; a text without any of them is in NFC.
NFC_HINT = r"[\x{300}-\x{10FFFF}&&[" + "".join(r"\x{%s}-\x{%s}" % tuple(r.split("-")) for r in """
300-387 483-487 591-11C2 135D-135F 1714-1DFF 1F71-2001 20D0-20F0 2126-212B 2329-232A 2ADC-2ADC 2CEF-2DFF 302A-309A A66F-A6F1 A806-ABED F900-FB4E
FE20-FE2F 101FD-1037A 10A0D-1E94A 2F800-2FA1D
""".split()) + "]]"
