"""Text column functions: cleaning, normalisation, tokens.

All of these return ``Column`` expressions that run inside the JVM (regex,
higher-order array functions). Steps that read their input several times
bind it to a lambda variable first (``bind``), so the chained expression tree
stays linear. The only Python step is Unicode NFC, which
Spark has no built-in for; it is an Arrow-batched pandas UDF that only
receives the non-ASCII values.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse import constants as K
from textpulse.functions.stopwords import stop_words


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


@F.pandas_udf(T.StringType())
def _nfc_udf(s: pd.Series) -> pd.Series:
    def norm(t):
        if t is None or unicodedata.is_normalized("NFC", t):
            return t
        return unicodedata.normalize("NFC", t)
    return s.map(norm, na_action="ignore")


def nfc(col) -> Column:
    """Unicode NFC (STR-2). Only values that may not be in NFC leave the JVM
    (``NFC_HINT``): the UDF is fed null for the others, so neither its time nor
    its Arrow batches grow with texts that are in NFC already."""
    c = _c(col)
    is_ascii = F.octet_length(c) == F.length(c)
    return F.coalesce(_nfc_udf(F.when(~is_ascii & c.rlike(K.NFC_HINT), c)), c)


def is_blank(col) -> Column:
    """Null, empty, or white space only (Python's ``not s.strip()``)."""
    c = _c(col)
    return c.isNull() | ~c.rlike(K.NOT_WS)


def bind(col, fn) -> Column:
    """Evaluate ``fn`` on one value that it may read several times.

    ``fn`` receives a lambda variable bound to ``col`` (through a one-element
    array), so the optimizer never inlines ``col`` repeatedly into ``fn``'s
    expression tree; chained steps stay a linear tree however often each
    step looks at its input (guards read it two or three times)."""
    return F.element_at(F.transform(F.array(_c(col)), fn), 1)


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns taken as they are from here on: a filter on one
    of them stays behind their derivation, where it would else be pushed below
    it and derive the column a second time. Select the columns needed before."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def bind_many(cols: dict, fn) -> Column:
    """Like ``bind`` for several inputs: ``fn`` receives a dict of lambda
    variables (one per named column). Used wherever a derived value reads
    its inputs more than once, so that optimizer rewrites that substitute
    column definitions (predicate pushdown, projection collapsing) copy each
    input once instead of multiplying the tree at every stage."""
    packed = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])
    return F.element_at(F.transform(F.array(packed), lambda x: fn({n: x[n] for n in cols})), 1)


def _guarded(needle: str, replaced) -> callable:
    """Run an expensive regex only on values that contain ``needle`` (a plain
    substring every match must contain); other values pass through. A byte
    search is far cheaper than a regex scan, and most posts have no URL,
    mention or contraction. The result is identical either way."""
    return lambda x: F.when(x.contains(needle), replaced(x)).otherwise(x)


def remove_urls(col) -> Column:
    """STR-3: drop ``https?://`` followed by non-space characters."""
    return bind(col, _guarded("://", lambda x: F.regexp_replace(x, "https?://" + K.NOT_WS + "+", "")))


def remove_mentions(col) -> Column:
    """STR-4: drop ``u/name`` then ``r/name`` starting at a word boundary
    (two passes, like two separate substitutions). The pattern begins with the
    prefix and looks back from there: only places that hold it are tested. (A
    letter beyond U+FFFF in the pattern makes the JVM look back by whole ones.)"""
    out = _c(col)
    for prefix in ("u/", "r/"):
        pat = prefix + "(?<![" + K.WORD_CLASS + "\U00020000]" + prefix + ")[" + K.WORD_CLASS + "]+"
        out = bind(out, _guarded(prefix, lambda x, p=pat: F.regexp_replace(x, p, "")))
    return out


def _unify_ws(x: Column) -> Column:
    return F.when(x.rlike(K.WS_HINT), F.regexp_replace(x, K.WS_NOT_SPACE, " ")).otherwise(x)


def _plain_ws(x: Column) -> Column:
    for c in "\t\n\x0b\f\r":
        x = F.replace(x, F.lit(c), F.lit(" "))
    return x


def collapse_whitespace(col) -> Column:
    """STR-5a: every white-space run becomes one space.

    Unicode / control white space is first mapped to a plain space (only on
    values that can contain it), tabs and line ends by byte searches; runs of
    two or more spaces are collapsed where there are any."""
    plain = _plain_ws(bind(col, _unify_ws))
    return bind(plain, _guarded("  ", lambda x: F.regexp_replace(x, "  +", " ")))


def strip_spaces(col) -> Column:
    """STR-5b: drop the (single, after collapsing) leading / trailing space."""
    return bind(col, lambda x: F.when(x.startswith(" ") | x.endswith(" "), F.regexp_replace(x, "^ | $", "")).otherwise(x))


def _drop_emoji(x: Column) -> Column:
    is_ascii = F.octet_length(x) == F.length(x)
    no_keycap = F.regexp_replace(x, K.EMOJI_SEQUENCE_JVM, "")
    keycap = F.regexp_replace(x, K.EMOJI_JVM, "")
    return (F.when(is_ascii | ~x.rlike(K.EMOJI_HINT), x)
            .when(x.contains("\u20e3"), keycap)
            .otherwise(no_keycap))


def remove_emoji(col) -> Column:
    """STR-6: drop emoji (with their joiners and selectors) and keycaps.

    The full emoji class is only scanned on values holding a candidate code
    point (a much cheaper test); keycap sequences only when U+20E3 occurs."""
    return bind(col, _drop_emoji)


def _has_slang(x: Column) -> Column:
    """Whether a lower-case value holds a contraction without apostrophe."""
    out = F.lit(False)
    for p, _ in K.CONTRACTIONS:
        if "'" not in p:
            out = out | x.contains(p)
    return out


def contraction_candidate(col) -> Column:
    """True when a value may hold a contraction: an apostrophe or one of the
    apostrophe-free slang words (any case)."""
    return bind(col, lambda x: x.contains("'") | bind(F.lower(x), _has_slang))


def _expand(apostrophe: bool) -> callable:
    """Each contraction's regex runs only where the lower-cased value, as it
    came in, holds it: no replacement makes a contraction that wasn't there."""
    def replaced(low: Column, pattern: str, repl: str) -> callable:
        return lambda y: F.when(low.contains(pattern), F.regexp_replace(y, "(?i)" + pattern, repl)).otherwise(y)

    def run(x: Column) -> Column:
        def fold(low: Column) -> Column:
            out = x
            for pattern, repl in K.CONTRACTIONS:
                if ("'" in pattern) == apostrophe:
                    out = bind(out, replaced(low, pattern, repl))
            return out
        return bind(F.lower(x), fold)
    return run


def expand_contractions(col) -> Column:
    """STR-7: case-insensitive left fold over the ordered contraction list
    (those with an apostrophe come first), each half run only on values that
    may hold one of it."""
    some = bind(col, _guarded("'", _expand(True)))
    return bind(some, lambda x: F.when(bind(F.lower(x), _has_slang), _expand(False)(x)).otherwise(x))


def clean_text(col, lang=None, compat: bool = True) -> Column:
    """STR-1: full cleaning of one text column.

    Order: blank -> "", NFC, URLs, u/ and r/ mentions, white space, emoji,
    contractions.

    ``compat=True`` keeps the analysed behaviour exactly: emoji go after the
    white-space pass (``"hi 😀"`` keeps its trailing space) and contractions
    are expanded on every row, French included. ``compat=False`` removes
    emoji first and expands contractions only where ``lang`` is ``en``.
    """
    c = _c(col)
    t = remove_mentions(remove_urls(nfc(c)))
    if compat:
        t = expand_contractions(remove_emoji(strip_spaces(collapse_whitespace(t))))
    else:
        t = strip_spaces(collapse_whitespace(remove_emoji(t)))
        if lang is not None:
            t = bind(t, lambda x: F.when(_c(lang) == "en", expand_contractions(x)).otherwise(x))
    return F.when(is_blank(c), F.lit("")).otherwise(t)


def strip_unicode(col) -> Column:
    """STR-8: Python ``str.strip()`` (Unicode white space on both ends)."""
    return F.regexp_replace(_c(col), "^" + K.WS + "+|" + K.WS + "+$", "")


def word_count(col) -> Column:
    """Number of white-space separated words (``len(s.split())``)."""
    c = _c(col)
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(K.NOT_WS + "+"), F.lit(0))),
                      F.lit(0))


def has_min_words(col, n: int) -> Column:
    """``len(s.split()) >= n`` without splitting the whole text: an anchored
    regex that stops after the n-th word. Null -> False."""
    c = _c(col)
    pat = "^" + K.WS + "*(" + K.NOT_WS + "+" + K.WS + "+){" + str(n - 1) + "}" + K.NOT_WS
    return F.coalesce(c.rlike(pat), F.lit(False))


def raw_tokens(col) -> Column:
    """TOK-1: lower-case word tokens (letters, marks, digits, underscore).
    Tokens are extracted first and lower-cased one by one (same result as
    lower-casing the text, since the token class is closed under case)."""
    return F.transform(F.regexp_extract_all(_c(col), F.lit(K.TOKEN_PATTERN), F.lit(0)),
                       lambda t: F.lower(t))


def _content_tokens(col) -> Column:
    """TOK-1 and TOK-3 without the stop list: the lower-case tokens of more than
    one character (after lower-casing) that are not number-like, by one pattern."""
    return F.transform(F.regexp_extract_all(_c(col), F.lit(K.CONTENT_TOKEN_JVM), F.lit(0)),
                       lambda t: F.lower(t))


def drop_stop_words(arr: Column, lang: str) -> Column:
    """TOK-3 stop-word removal with Spark ML's default list for ``lang``.

    ``isin`` over a literal list is rewritten by the optimizer into a
    hash-set membership test (``InSet``), so this stays codegen'd JVM work.
    """
    words = stop_words(lang)
    return F.filter(arr, lambda t: ~t.isin(words))


def tokens_for(text_col, lang_col) -> Column:
    """TOK-5: tokens for en / fr rows, empty array for any other language."""
    base = _content_tokens(text_col)
    lang = _c(lang_col)
    empty = F.array().cast("array<string>")
    return (F.when(lang == "en", drop_stop_words(base, "english"))
            .when(lang == "fr", drop_stop_words(base, "french"))
            .otherwise(empty))


def excerpt(col, n: int = K.EXCERPT_CHARS) -> Column:
    """STR-13: first ``n`` code points followed by ``...`` (always)."""
    return F.concat(F.substring(_c(col), 1, n), F.lit("..."))


def format_count_pct(n_col, total_col) -> Column:
    """STR-15: ``1,234 (5.6%)``; null when the total is 0."""
    from textpulse.functions.numeric import rnd
    n = _c(n_col)
    total = _c(total_col)
    share = rnd(n.cast("double") * 100.0 / total, 1)  # rounded first: same text everywhere
    return F.when(total > 0, F.format_string("%,d (%.1f%%)", n, share))
