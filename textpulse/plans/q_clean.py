"""Registered queries: ingest, clean stage, tokens (SRC, SET, WIN-1, PRJ, STR, DAT, TOK)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.functions import dates as D
from textpulse.functions import text as TX
from textpulse.functions.numeric import to_bool
from textpulse.operators import cleaning as CL
from textpulse.operators import langid as LID
from textpulse.operators import sampling
from textpulse.operators.dedup import keep_first
from textpulse.operators import tokens as TK
from textpulse.operators.sentiment import model_key, placeholder_text
from textpulse.operators.tokens import lemmatize
from textpulse.plans import fixtures as FX
from textpulse.plans import sqlgen as S
from textpulse.plans.registry import register
from textpulse.plans.stages import clean_table
from textpulse.sources.readers import pick_stage, read_exports, union_by_name
from textpulse.sources.sinks import export_clean, fresh_dir, materialize, write_stage

CLEAN_OUT = ["post_id", "forum", "title", "category", "text_clean", "text_source", "text_lemma",
             "n_tokens", "year", "month", "lang", "lang_detected", "lang_conflict",
             "n_chars_clean", "is_empty", "is_too_short"]


def _with(cte: str, select: str) -> str:
    return f"WITH {cte}\n{select}"


@register("clean_stage", sql=lambda: _with(S.clean_cte(), f"SELECT {', '.join(CLEAN_OUT)} FROM clean"))
def clean_stage(spark, sf_dir):
    """CLN-1 / TOK-5: the whole clean stage."""
    return clean_table(spark, sf_dir).select(*CLEAN_OUT)


@register("clean_stage_detected")
def clean_stage_detected(spark, sf_dir):
    """CLN-1 in full: language id (LID-1, trained on the labelled documents)
    and lemmas (TOK-2, unseen forms by rule) inside the stage (rows-only check
    here; the parts have their own twins)."""
    model = LID.train_compact(FX.read_table(spark, sf_dir, "documents"), text_col="text", label_col="lang")
    posts = FX.posts_raw(spark, sf_dir).drop("lang_detected")
    clean = CL.clean_posts(posts, detector=LID.detector(model))
    out = materialize(spark, clean.select(*[c for c in CLEAN_OUT if c != "text_lemma"], "tokens"), "clean-detected")
    known = materialize(spark, corpus_dictionary(out), "lemma-dictionary")
    out = CL.with_lemmas(out, TK.lemma_table(out, known))
    return out.select(*CLEAN_OUT)


@register("union_by_name", sql=lambda: """
SELECT * FROM (
  SELECT doc_id AS post_id, 'documents' AS origin, lang, source, NULL::VARCHAR AS role,
         CAST(length(text) AS INTEGER) AS n_chars FROM documents
  UNION ALL BY NAME
  SELECT conv_id AS post_id, 'conversations' AS origin, NULL::VARCHAR AS lang, NULL::VARCHAR AS source,
         role, CAST(length(text) AS INTEGER) AS n_chars FROM conversations)""")
def union_query(spark, sf_dir):
    """SRC-1 / SET-1: two exports with different columns, unioned by name."""
    docs = FX.read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("post_id"), F.lit("documents").alias("origin"), "lang", "source",
        F.length("text").alias("n_chars"))
    conv = FX.read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("post_id"), F.lit("conversations").alias("origin"), "role",
        F.length("text").alias("n_chars"))
    return union_by_name([docs, conv]).select("post_id", "origin", "lang", "source", "role", "n_chars")


def _export_of(forum: str) -> str:
    return f"posts_of_{forum if forum != 'CollegeRant' else 'collegerant'}_new"


def _exports_sql() -> str:
    rank = {f: K.EXPORT_NAMES.index(_export_of(f)) for f in FX.FORUMS if _export_of(f) in K.EXPORT_NAMES}
    return _with(S.posts_cte(), f"""SELECT post_id, forum, title, text, {S.case_map('forum', rank)} AS file_rank
FROM posts_raw WHERE forum IN ({', '.join(S.q(f) for f in rank)})""")


@register("exports_read", sql=_exports_sql)
def exports_query(spark, sf_dir):
    """SRC-1, SRC-2, SRC-3, SET-1: one export a forum, the first with a numeric
    prefix, written, found by name, read back and united
    (a forum without an export is skipped)."""
    posts = materialize(spark, FX.posts_raw(spark, sf_dir).select("post_id", "forum", "title", "text"), "posts")
    folder = fresh_dir(spark, "exports")
    for forum in FX.FORUMS:
        if _export_of(forum) in K.EXPORT_NAMES:
            name = _export_of(forum) if forum != "college" else "01_" + _export_of(forum)
            write_stage(posts.where(F.col("forum") == forum), f"{folder}/{name}.parquet")
    return read_exports(spark, folder).select("post_id", "forum", "title", "text", "file_rank")


@register("stage_export", sql=lambda: _with(S.clean_cte(), "SELECT post_id, lang, text_clean, n_tokens, is_empty, year FROM clean"))
def stage_export_query(spark, sf_dir):
    """SNK-1, SNK-2, PRJ-9, SRC-4: the clean table's known columns written,
    partitioned by language, and found again as the best stage that is there."""
    folder = fresh_dir(spark, "stages")
    c = clean_table(spark, sf_dir).withColumn("scratch", F.lit(1))
    export_clean(c, f"{folder}/clean", partition_by=["lang"])
    stage = pick_stage(spark, [f"{folder}/enriched", f"{folder}/clean"])
    assert "scratch" not in stage.columns
    return stage.select("post_id", "lang", "text_clean", "n_tokens", "is_empty", "year")


@register("dedup_keep_first", sql=lambda: _with(S.posts_cte(), """
SELECT post_id, title, file_rank, row_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY file_rank, row_pos) AS rn FROM posts_raw)
WHERE rn = 1"""))
def dedup_query(spark, sf_dir):
    """WIN-1 / SET-2: keep the first row per post id in ingest order."""
    raw = FX.posts_raw(spark, sf_dir)
    return keep_first(raw, "post_id", ["file_rank", "row_pos"]).select(
        "post_id", "title", "file_rank", "row_pos")


@register("forum_lang_lookup", sql=lambda: _with(S.posts_cte(),
          f"SELECT post_id, file_rank, forum, {S.forum_lang('forum')} AS lang FROM posts_raw"))
def forum_lang_query(spark, sf_dir):
    """PRJ-1 / JOI-1: forum -> expected language."""
    return FX.posts_raw(spark, sf_dir).select("post_id", "file_rank", "forum",
                                              CL.forum_lang("forum").alias("lang"))


@register("clean_text", sql=lambda: _with(S.posts_cte(),
          f"SELECT post_id, file_rank, {S.clean_text('text')} AS text_clean, "
          f"{S.clean_text('title')} AS title_clean FROM posts_raw"))
def clean_text_query(spark, sf_dir):
    """STR-1..7: the cleaning chain on bodies and titles (whole texts)."""
    raw = FX.posts_raw(spark, sf_dir)
    out = CL.clean_text_column(CL.clean_text_column(raw, "text", "text_clean"), "title", "title_clean")
    return out.select("post_id", "file_rank", "text_clean", "title_clean")


@register("title_fallback_flags", sql=lambda: _with(S.clean_cte(),
          "SELECT post_id, is_empty, text_source, text_clean FROM clean"))
def title_fallback_query(spark, sf_dir):
    """PRJ-2..4: empty flag, title fallback, source tag."""
    return clean_table(spark, sf_dir).select("post_id", "is_empty", "text_source", "text_clean")


@register("category_strip_len", sql=lambda: _with(S.clean_cte(),
          "SELECT post_id, category, n_chars_clean FROM clean"))
def category_query(spark, sf_dir):
    """STR-8 / STR-9: stripped category, length in code points."""
    return clean_table(spark, sf_dir).select("post_id", "category", "n_chars_clean")


@register("parse_dates", sql=lambda: _with(S.clean_cte(), """
SELECT post_id, posted_raw, posted_at, year, month,
       make_date(year, month, 1) AS month_start,
       lpad(CAST(month AS VARCHAR), 2, '0') AS period
FROM clean"""))
def parse_dates_query(spark, sf_dir):
    """DAT-1..3 / STR-16: timestamp parse (bad -> null), year, month,
    first of month, zero-padded month."""
    c = clean_table(spark, sf_dir)
    return c.select("post_id", "posted_raw", "posted_at", "year", "month",
                    D.month_start("year", "month").alias("month_start"),
                    D.period_label("month").alias("period"))


@register("lang_conflict", sql=lambda: _with(S.clean_cte(),
          "SELECT post_id, forum, lang_detected, lang_conflict, lang FROM clean"))
def lang_conflict_query(spark, sf_dir):
    """PRJ-5 / PRJ-6: conflict flag and resolution."""
    return clean_table(spark, sf_dir).select("post_id", "forum", "lang_detected",
                                             "lang_conflict", "lang")


@register("tokenize_stop", sql=lambda: _with(S.clean_cte(),
          "SELECT post_id, lang, text_lemma, n_tokens, is_too_short FROM clean"))
def tokenize_query(spark, sf_dir):
    """TOK-1, TOK-3, TOK-4, ARR-1, ARR-2, PRJ-7."""
    return clean_table(spark, sf_dir).select("post_id", "lang", "text_lemma", "n_tokens",
                                             "is_too_short")


def _lemma_sql() -> str:
    rows = ", ".join(f"({S.q(a)}, {S.q(b)}, {S.q(c)})" for a, b, c in FX.LEMMA_ROWS)
    return _with(S.clean_cte() + f""",
dict AS (SELECT * FROM (VALUES {rows}) t(lang, form, lemma)),
tok AS (SELECT post_id, lang, unnest(tokens) AS tok, unnest(generate_series(1, len(tokens))) AS pos FROM clean),
lem AS (SELECT t.post_id, t.pos, coalesce(d.lemma, t.tok) AS lemma
        FROM tok t LEFT JOIN dict d ON d.lang = t.lang AND d.form = t.tok),
agg AS (SELECT post_id, list(lemma ORDER BY pos) AS lemmas FROM lem GROUP BY post_id)""", """
SELECT c.post_id, c.lang, coalesce(array_to_string(a.lemmas, ' '), '') AS text_lemma,
       CAST(coalesce(len(a.lemmas), 0) AS INTEGER) AS n_lemmas
FROM clean c LEFT JOIN agg a ON a.post_id = c.post_id""")


@register("lemma_dictionary", sql=_lemma_sql)
def lemma_query(spark, sf_dir):
    """TOK-2: token -> lemma through a (lang, form, lemma) dictionary table."""
    c = clean_table(spark, sf_dir)
    out = lemmatize(c, FX.lemma_df(spark), key="post_id", tokens_col="tokens", out_col="lemmas")
    return out.select("post_id", "lang", F.array_join("lemmas", " ").alias("text_lemma"),
                      F.size("lemmas").alias("n_lemmas"))


#: Endings by which the corpus' own forms are paired with shorter ones, longest first.
CORPUS_ENDINGS = [("en", "ing"), ("en", "ed"), ("en", "es"), ("en", "s"), ("fr", "ment"), ("fr", "es"), ("fr", "er"), ("fr", "s")]


def corpus_dictionary(tokens):
    """(lang, form, lemma) of the forms of which the corpus also has a shorter
    one without one of the endings (the longest that leaves such a form)."""
    forms = materialize(tokens.sparkSession, tokens.select("lang", F.explode("tokens").alias("form")).distinct(), "corpus-forms")
    pairs = None
    for k, (lang, end) in enumerate(CORPUS_ENDINGS):
        one = forms.where((F.col("lang") == lang) & F.col("form").endswith(end) & (F.length("form") >= len(end) + 3)) \
            .select("lang", "form", F.expr(f"substr(form, 1, length(form) - {len(end)})").alias("lemma"), F.lit(k).alias("_k"))
        pairs = one if pairs is None else pairs.unionByName(one)
    there = pairs.join(forms.select("lang", F.col("form").alias("lemma")), ["lang", "lemma"], "left_semi")
    return there.groupBy("lang", "form").agg(F.min_by("lemma", "_k").alias("lemma"))


def _lemma_rules_sql() -> str:
    pairs = " UNION ALL ".join(f"SELECT lang, form, substr(form, 1, length(form) - {len(e)}) AS lemma, {k} AS k FROM forms "
                               f"WHERE lang = '{lg}' AND form LIKE '%{e}' AND length(form) >= {len(e) + 3}" for k, (lg, e) in enumerate(CORPUS_ENDINGS))
    return _with(S.clean_cte() + f""",
forms AS (SELECT DISTINCT lang, unnest(tokens) AS form FROM clean),
pairs AS ({pairs}),
dict AS (SELECT lang, form, arg_min(lemma, k) AS lemma FROM pairs p WHERE EXISTS (SELECT 1 FROM forms f WHERE f.lang = p.lang AND f.form = p.lemma) GROUP BY lang, form),
e AS (SELECT *, (SELECT count(*) FROM range(1, least(length(form), length(lemma)) + 1) r(i) WHERE substr(form, 1, i) = substr(lemma, 1, i)) AS p FROM dict),
x AS (SELECT lang, form, length(form) - p AS cut, substr(lemma, CAST(p + 1 AS BIGINT)) AS add FROM e),
s AS (SELECT lang, form, cut, add, unnest(range(greatest(cut, 1), least(length(form), {TK.LONGEST_SUFFIX}) + 1)) AS k FROM x),
v AS (SELECT lang, right(form, k) AS suffix, cut, add, count(*) AS votes FROM s GROUP BY ALL),
r AS (SELECT lang, suffix, cut, add FROM (SELECT *, sum(votes) OVER w AS total, row_number() OVER (w ORDER BY votes DESC, cut, add) AS place
      FROM v WINDOW w AS (PARTITION BY lang, suffix)) WHERE place = 1 AND votes >= {TK.LEAST_SUPPORT} AND votes >= {TK.LEAST_SHARE} * total),
n AS (SELECT lang, form, unnest(range(1, least(length(form), {TK.LONGEST_SUFFIX}) + 1)) AS k FROM forms WHERE (lang, form) NOT IN (SELECT (lang, form) FROM dict)),
h AS (SELECT n.lang, n.form, n.k, left(n.form, CAST(length(n.form) - r.cut AS BIGINT)) || r.add AS made FROM n JOIN r ON r.lang = n.lang AND r.suffix = right(n.form, n.k)),
m AS (SELECT lang, form, arg_max(made, k) AS made FROM h WHERE made <> '' GROUP BY lang, form)""",
        """SELECT f.lang, f.form, coalesce(d.lemma, m.made, f.form) AS lemma,
  CASE WHEN d.lemma IS NOT NULL THEN 'dictionary' WHEN m.made IS NOT NULL THEN 'rule' ELSE 'form' END AS source
FROM forms f LEFT JOIN dict d ON d.lang = f.lang AND d.form = f.form LEFT JOIN m ON m.lang = f.lang AND m.form = f.form
WHERE f.lang IS NOT NULL""")


@register("lemma_rules", sql=_lemma_rules_sql)
def lemma_rules_query(spark, sf_dir):
    """TOK-2 for unseen forms: a dictionary of the corpus' own forms, suffix
    rules learnt from it, and the lemma of every distinct form."""
    c = materialize(spark, clean_table(spark, sf_dir).select("lang", "tokens"), "lemma-tokens")
    known = materialize(spark, corpus_dictionary(c), "lemma-dictionary")
    forms = c.select("lang", F.explode("tokens").alias("form"))
    return TK.lemmas_of_forms(forms, known, TK.lemma_rules(known))


@register("bool_coerce", sql=lambda: _with(S.clean_cte(), """
SELECT post_id,
  coalesce(lower(CASE WHEN post_id % 3 = 0 THEN upper(CAST(is_empty AS VARCHAR))
                      WHEN post_id % 3 = 1 THEN CAST(is_empty AS VARCHAR) ELSE 'maybe' END) = 'true', false) AS is_empty_b,
  coalesce(lower(CAST(is_too_short AS VARCHAR)) = 'true', false) AS is_too_short_b,
  coalesce(lower(CAST(CASE WHEN post_id % 7 = 0 THEN NULL ELSE lang_conflict END AS VARCHAR)) = 'true', false) AS lang_conflict_b
FROM clean"""))
def bool_coerce_query(spark, sf_dir):
    """PRJ-8: string booleans (any case, junk, null) back to booleans."""
    c = clean_table(spark, sf_dir)
    pid = F.col("post_id")
    s_empty = (F.when(pid % 3 == 0, F.upper(F.col("is_empty").cast("string")))
               .when(pid % 3 == 1, F.col("is_empty").cast("string")).otherwise(F.lit("maybe")))
    s_conf = F.when(pid % 7 == 0, F.lit(None)).otherwise(F.col("lang_conflict")).cast("string")
    return c.select("post_id", to_bool(s_empty).alias("is_empty_b"),
                    to_bool(F.col("is_too_short").cast("string")).alias("is_too_short_b"),
                    to_bool(s_conf).alias("lang_conflict_b"))


@register("model_route", sql=lambda: _with(S.clean_cte(), f"""
SELECT post_id, lang, CASE WHEN lang = 'fr' THEN 'fr' ELSE 'en' END AS model_key,
  CASE WHEN {S.is_blank('text_clean')} THEN '.' ELSE text_clean END AS model_text
FROM clean"""))
def model_route_query(spark, sf_dir):
    """FLT-3 / PRJ-11: model routing and the blank-text placeholder."""
    c = clean_table(spark, sf_dir)
    return c.select("post_id", "lang", model_key("lang").alias("model_key"),
                    placeholder_text("text_clean").alias("model_text"))


@register("en_fr_min_tokens", sql=lambda: _with(S.clean_cte(), f"""
SELECT post_id, lang, n_tokens,
  CASE WHEN trim(coalesce(text_lemma, '')) <> '' THEN text_lemma ELSE text_clean END AS topic_text
FROM clean WHERE lang IN ('en', 'fr') AND n_tokens >= {K.MIN_TOKENS}"""))
def en_fr_query(spark, sf_dir):
    """FLT-1, FLT-2, PRJ-10: the topic-model input filter and text choice."""
    from textpulse.operators.topics import topic_input
    clean = clean_table(spark, sf_dir).select("post_id", "lang", "n_tokens", "text_clean", "text_lemma")
    return topic_input(TX.settled(clean)).select("post_id", "lang", "n_tokens", "topic_text")


@register("sample_n")
def sample_query(spark, sf_dir):
    """FLT-9: exactly N rows, reproducible, partition-independent (here N is
    half of the documents: a parameter of the sampling operator)."""
    docs = FX.read_table(spark, sf_dir, "documents")
    n = docs.count() // 2
    return sampling.sample_n(docs, n, key="doc_id").select("doc_id", "lang", "source")
