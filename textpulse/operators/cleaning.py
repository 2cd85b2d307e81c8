"""The clean stage (CLN-1) and its projections (PRJ-1..7).

One lazy plan: dedup -> expected language -> clean body -> empty flag ->
title fallback -> source tag -> length -> category -> dates -> detected
language -> conflict resolution -> tokens -> short flag.
The dedup shuffles ids and places only (see ``dedup``); everything after it is
narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.functions import dates as D
from textpulse.functions import text as TX
from textpulse.operators.dedup import keep_first


def forum_lang(col) -> Column:
    """PRJ-1 / JOI-1: forum -> expected language, default ``unknown``.

    The lookup is case-sensitive, as in the analysed pipeline."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for forum, lang in K.FORUM_LANG.items():
        expr = F.when(c == forum, lang) if expr is None else expr.when(c == forum, lang)
    return expr.otherwise("unknown")


def detected_language(text_col, lang_col) -> Column:
    """LID-1 post-rules on a raw detector label: fewer than 5 words ->
    ``unknown``; en / fr kept; any other label -> ``other``; null -> unknown."""
    lab = F.col(lang_col) if isinstance(lang_col, str) else lang_col
    return (F.when(~TX.has_min_words(text_col, K.MIN_TOKENS), "unknown")
            .when(lab.isin("en", "fr"), lab)
            .when(lab.isNull(), "unknown")
            .otherwise("other"))


def clean_text_column(df: DataFrame, src: str, dst: str, lang: str | None = None,
                      compat: bool = True) -> DataFrame:
    """STR-1: clean ``src`` into ``dst`` (see ``functions.text.clean_text``)."""
    return df.withColumn(dst, TX.clean_text(src, lang=lang, compat=compat))


def add_clean_columns(df: DataFrame, compat: bool = True) -> DataFrame:
    """PRJ-1..4, STR-1..9, DAT-1..2: columns that need no language id.

    Independent columns are added together (``withColumns``) to keep the
    number of plan re-analyses small."""
    lang = forum_lang("forum")
    first = {"lang": lang,
             "_body_clean": TX.clean_text("text", lang=lang, compat=compat),
             "_title_clean": TX.clean_text("title", lang=lang, compat=compat)}
    if "category" in df.columns:
        first["category"] = TX.strip_unicode("category")
    if "posted_raw" in df.columns:
        first["posted_at"] = D.parse_timestamp("posted_raw")
    elif "posted_at" in df.columns:
        first["posted_at"] = D.parse_timestamp("posted_at")
    out = df.withColumns(first)
    is_empty = F.col("_body_clean") == ""
    has_title = F.col("title").isNotNull()
    text_clean = F.when(is_empty & has_title, F.col("_title_clean")).otherwise(F.col("_body_clean"))
    second = {"is_empty": is_empty,
              "text_clean": text_clean,
              "text_source": (F.when(is_empty & has_title, "titre")
                              .when(~is_empty & has_title, "titre+texte")
                              .otherwise("texte"))}
    if "posted_at" in out.columns:
        second["year"] = F.year("posted_at")
        second["month"] = F.month("posted_at")
    out = out.withColumns(second).drop("_body_clean", "_title_clean")
    return out.withColumn("n_chars_clean", F.length("text_clean"))


def resolve_language(df: DataFrame, detected_col: str = "lang_detected") -> DataFrame:
    """PRJ-5 / PRJ-6: flag a conflict when the detector is sure and disagrees
    with the forum language, then trust the detector (flag stays True)."""
    det = F.coalesce(F.col(detected_col), F.lit("unknown"))
    conflict = (det != "unknown") & (det != F.col("lang"))
    out = df.withColumns({detected_col: det, "lang_conflict": conflict})
    return out.withColumn("lang", F.when(F.col("lang_conflict"), F.col(detected_col))
                          .otherwise(F.col("lang")))


def add_tokens(df: DataFrame, text_col: str = "text_clean", lang_col: str = "lang") -> DataFrame:
    """TOK-5 + PRJ-7: tokens, lemma text, token count, short flag."""
    out = df.withColumn("tokens", TX.tokens_for(text_col, lang_col))
    n = F.size("tokens")
    return out.withColumns({"text_lemma": F.array_join("tokens", " "), "n_tokens": n,
                            "is_too_short": n < K.MIN_TOKENS})


def _repeatable(df: DataFrame) -> bool:
    """Whether a second read gives each row the same columns: not so where a
    row's place is dealt as it is read (exports in CSV) or on a stream."""
    return not df.isStreaming and bool(df._jdf.queryExecution().analyzed().deterministic())


def clean_posts(posts: DataFrame, detector=None, compat: bool = True, lemmas: DataFrame | None = None,
                key: str = "post_id", order_by=("file_rank", "row_pos")) -> DataFrame:
    """CLN-1: raw posts -> clean table.

    ``detector``: optional callable ``(DataFrame, text_col) -> DataFrame`` that
    adds ``lang_detected``; when omitted the input must carry that column.
    ``lemmas``: optional (lang, form, lemma) dictionary; tokens are replaced by
    their lemmas in ``text_lemma`` (without it, the surface tokens).
    ``order_by``: what tells the rows of a post apart, as the readers set it.
    """
    order = [c for c in order_by if c in posts.columns]
    df = keep_first(posts, key, order or [key], unique_order=len(order) == len(order_by) and _repeatable(posts))
    df = add_clean_columns(df, compat=compat)
    if detector is not None:
        df = detector(df, "text_clean")
    df = add_tokens(resolve_language(df))
    return df if lemmas is None else with_lemmas(df, lemmas, key)


def with_lemmas(df: DataFrame, lemmas: DataFrame, key: str = "post_id") -> DataFrame:
    """TOK-2 on clean posts: ``text_lemma`` from a (lang, form, lemma) table.
    ``df`` is read three times: pass a written table."""
    from textpulse.operators.tokens import lemma_texts
    return lemma_texts(df, lemmas, key)


CLEAN_COLUMNS = ["post_id", "forum", "author", "title", "text", "category",
                 "n_comments", "n_reactions", "posted_at", "text_clean", "text_source",
                 "tokens", "text_lemma", "n_tokens", "year", "month", "lang",
                 "lang_detected", "lang_conflict", "n_chars_clean", "is_empty",
                 "is_too_short"]
