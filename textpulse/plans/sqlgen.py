"""SQL twins of the column functions, for the DuckDB oracle.

Each builder returns a SQL expression string computing the same value as the
Spark ``Column`` function of the same name, from the same constants. Regex
patterns are shared verbatim: they are written in the subset that Java regex
and RE2 read identically.
"""

from __future__ import annotations

from textpulse import constants as K
from textpulse.functions.stopwords import stop_words
from textpulse.plans import fixtures as FX


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def case_map(expr: str, mapping: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {expr} = {q(k) if isinstance(k, str) else k} THEN "
                     f"{q(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    tail = f" ELSE {default}" if default is not None else ""
    return f"(CASE {whens}{tail} END)"


def rnd(expr: str, digits: int = 4) -> str:
    scale = float(10 ** digits)
    return f"CAST(floor(CAST({expr} AS DOUBLE) * {scale!r} + 0.5::DOUBLE) / {scale!r} AS DOUBLE)"


def grid_mean(expr: str, digits: int = 4) -> str:
    scale = 10 ** digits
    return (f"CAST(floor(CAST(sum(CAST(round(CAST({expr} AS DOUBLE) * {float(scale)!r}) AS BIGINT)) AS DOUBLE)"
            f" / count({expr}) + 0.5::DOUBLE) / {float(scale)!r} AS DOUBLE)")


def grid_std(expr: str, digits: int = 4) -> str:
    scale = float(10 ** digits)
    k = f"CAST(round(CAST({expr} AS DOUBLE) * {scale!r}) AS BIGINT)"
    n = f"count({expr})"
    num = (f"(CAST({n} AS HUGEINT) * CAST(sum({k} * {k}) AS HUGEINT) - "
           f"CAST(sum({k}) AS HUGEINT) * CAST(sum({k}) AS HUGEINT))")
    var = f"(CAST({num} AS DOUBLE) / CAST({n} * ({n} - 1) AS DOUBLE))"
    return f"(CASE WHEN {n} >= 2 THEN {rnd(f'sqrt({var}) / {scale!r}', digits)} END)"


def pct(num: str, den: str, digits: int = 2) -> str:
    scale = float(10 ** digits)
    return (f"(CASE WHEN {den} > 0 THEN CAST(floor(CAST({num} AS DOUBLE) * {100.0 * scale!r} / {den}"
            f" + 0.5::DOUBLE) / {scale!r} AS DOUBLE) END)")


def is_blank(e: str) -> str:
    return f"({e} IS NULL OR NOT regexp_matches({e}, {q(K.NOT_WS)}))"


def clean_text(e: str, compat: bool = True) -> str:
    t = f"nfc_normalize({e})"
    t = f"regexp_replace({t}, {q('https?://' + K.NOT_WS + '+')}, '', 'g')"
    for prefix in ("u", "r"):
        pat = "(^|[^" + K.WORD_CLASS + "])" + prefix + "/[" + K.WORD_CLASS + "]+"
        t = f"regexp_replace({t}, {q(pat)}, '\\1', 'g')"
    if not compat:
        raise NotImplementedError("oracle SQL is generated for compat mode only")
    t = f"regexp_replace(regexp_replace({t}, {q(K.WS + '+')}, ' ', 'g'), '^ | $', '', 'g')"
    t = f"regexp_replace({t}, {q(K.EMOJI)}, '', 'g')"
    for pattern, repl in K.CONTRACTIONS:
        t = f"regexp_replace({t}, {q(pattern)}, {q(repl)}, 'gi')"
    return f"(CASE WHEN {is_blank(e)} THEN '' ELSE {t} END)"


def strip_unicode(e: str) -> str:
    return f"regexp_replace({e}, {q('^' + K.WS + '+|' + K.WS + '+$')}, '', 'g')"


def word_count(e: str) -> str:
    return f"coalesce(len(regexp_extract_all({e}, {q(K.NOT_WS + '+')})), 0)"


def has_min_words(e: str, n: int) -> str:
    pat = "^" + K.WS + "*(" + K.NOT_WS + "+" + K.WS + "+){" + str(n - 1) + "}" + K.NOT_WS
    return f"coalesce(regexp_matches({e}, {q(pat)}), false)"


def sql_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def tokens_for(text: str, lang: str) -> str:
    base = (f"list_filter(regexp_extract_all(lower({text}), {q(K.TOKEN_PATTERN)}), "
            f"lambda t: length(t) > 1 AND NOT regexp_full_match(t, {q(chr(92) + 'p{N}+')}))")
    en = f"list_filter({base}, lambda t: NOT list_contains({sql_list(stop_words('english'))}, t))"
    fr = f"list_filter({base}, lambda t: NOT list_contains({sql_list(stop_words('french'))}, t))"
    return (f"(CASE WHEN {lang} = 'en' THEN {en} WHEN {lang} = 'fr' THEN {fr} "
            f"ELSE []::VARCHAR[] END)")


def argmax_name(cols: dict[str, str], null_if_zero: bool = True) -> str:
    top = "greatest(" + ", ".join(cols.values()) + ")"
    whens = " ".join(f"WHEN {c} = {top} THEN {q(n)}" for n, c in cols.items())
    expr = f"(CASE {whens} END)"
    if null_if_zero:
        return f"(CASE WHEN {top} > 0 THEN {expr} END)"
    return expr


def distress_level(e: str) -> str:
    ed = K.DISTRESS_EDGES
    lv = K.DISTRESS_LEVELS
    return (f"(CASE WHEN {e} >= {ed[0]} AND {e} <= {ed[1]} THEN {q(lv[0])} "
            f"WHEN {e} > {ed[1]} AND {e} <= {ed[2]} THEN {q(lv[1])} "
            f"WHEN {e} > {ed[2]} AND {e} <= {ed[3]} THEN {q(lv[2])} "
            f"WHEN {e} > {ed[3]} AND {e} <= {ed[4]} THEN {q(lv[3])} END)")


def season(month: str) -> str:
    return case_map(month, K.SEASON_OF_MONTH)


def season_ordinal(s: str) -> str:
    return case_map(s, {n: i for i, n in enumerate(K.SEASON_ORDER)})


def forum_lang(forum: str) -> str:
    return case_map(forum, K.FORUM_LANG, "'unknown'")


# ---------------------------------------------------------------------------
# Stage CTEs
# ---------------------------------------------------------------------------

def posts_cte() -> str:
    forum = " ".join(f"WHEN TRY_CAST(substr(source, 4) AS BIGINT) % {len(FX.FORUMS)} = {i} THEN {q(f)}"
                     for i, f in enumerate(FX.FORUMS))
    suffix = ("(CASE WHEN doc_id % 5 = 0 THEN ' see https://ex.org/p' || CAST(doc_id AS VARCHAR) "
              "WHEN doc_id % 5 = 1 THEN ' thanks u/user_' || CAST(doc_id AS VARCHAR) "
              "WHEN doc_id % 5 = 2 THEN ' from r/college' "
              "WHEN doc_id % 5 = 3 THEN ' I can''t and won''t' "
              "ELSE ' \U0001F600' END)")
    ts = (f"TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST((doc_id * 37) % {FX.DATE_SPAN_DAYS} AS INTEGER))"
          f" + to_hours(CAST((doc_id * 7) % 24 AS INTEGER))")
    return f"""posts_base AS (
  SELECT doc_id AS post_id,
    (CASE {forum} END) AS forum,
    CASE WHEN doc_id % {FX.NULL_TITLE_MOD} = 0 THEN NULL ELSE 'Title ' || CAST(doc_id AS VARCHAR) END AS title,
    CASE WHEN doc_id % {FX.NULL_TEXT_MOD} = 0 THEN NULL ELSE text || {suffix} END AS text,
    '  ' || lang || ' ' AS category,
    CASE WHEN doc_id % {FX.BAD_DATE_MOD} = 0 THEN 'not a date' ELSE strftime({ts}, '%Y-%m-%d %H:%M:%S') END AS posted_raw,
    CASE WHEN NOT {has_min_words('text', K.MIN_TOKENS)} THEN 'unknown'
         WHEN lang IN ('en', 'fr') THEN lang ELSE 'other' END AS lang_detected,
    doc_id AS row_pos
  FROM documents),
posts_raw AS (
  SELECT post_id, forum, title, text, category, posted_raw, lang_detected, 0 AS file_rank, row_pos FROM posts_base
  UNION ALL
  SELECT post_id, forum, 'dup' AS title, text, category, posted_raw, lang_detected, 1 AS file_rank, row_pos
  FROM posts_base WHERE post_id % {FX.DUP_MOD} = 0)"""


def clean_cte() -> str:
    return posts_cte() + f""",
dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY file_rank, row_pos) AS rn FROM posts_raw)
  WHERE rn = 1),
c1 AS (SELECT *, {forum_lang('forum')} AS lang0, {clean_text('text')} AS body_clean FROM dedup),
c2 AS (
  SELECT *, body_clean = '' AS is_empty,
    CASE WHEN body_clean = '' AND title IS NOT NULL THEN {clean_text('title')} ELSE body_clean END AS text_clean,
    CASE WHEN body_clean = '' AND title IS NOT NULL THEN 'titre'
         WHEN body_clean <> '' AND title IS NOT NULL THEN 'titre+texte' ELSE 'texte' END AS text_source
  FROM c1),
c3 AS (
  SELECT * EXCLUDE (category, lang_detected),
    CAST(length(text_clean) AS INTEGER) AS n_chars_clean,
    {strip_unicode('category')} AS category,
    CAST(try_strptime(posted_raw, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS posted_at,
    coalesce(lang_detected, 'unknown') AS lang_detected
  FROM c2),
c4 AS (
  SELECT *, CAST(year(posted_at) AS INTEGER) AS year, CAST(month(posted_at) AS INTEGER) AS month,
    (lang_detected <> 'unknown' AND lang_detected <> lang0) AS lang_conflict
  FROM c3),
c5 AS (SELECT *, CASE WHEN lang_conflict THEN lang_detected ELSE lang0 END AS lang FROM c4),
clean AS (
  SELECT *, array_to_string(tokens, ' ') AS text_lemma, CAST(len(tokens) AS INTEGER) AS n_tokens,
    len(tokens) < {K.MIN_TOKENS} AS is_too_short
  FROM (SELECT *, {tokens_for('text_clean', 'lang')} AS tokens FROM c5))"""


def weights_list(labels: list[str], mult: int, add: int, mod: int) -> str:
    lab = sql_list(labels)
    n = len(labels)
    w = f"((post_id * (i * {mult} + {add})) % {mod} + 1)"
    total = f"list_sum([{w} for i in range(1, {n + 1})])"
    return f"[{{'label': {lab}[i], 'score': CAST({w} AS DOUBLE) / {total}}} for i in range(1, {n + 1})]"


def unified_class(label: str, key: str) -> str:
    parts = []
    for model, mapping in K.SENTIMENT_LABEL_MAPS.items():
        inner = case_map(f"lower({label})", mapping, "'neutral'")
        parts.append(f"WHEN {key} = {q(model)} THEN {inner}")
    return f"(CASE {' '.join(parts)} ELSE 'neutral' END)"


def emotion_of(label: str) -> str:
    return case_map(label, K.MODEL_LABEL_TO_EMOTION)


def lexicon_sql() -> str:
    rows = ", ".join(f"({q(w)}, {q(e)}, {a})" for w, e, a in FX.LEXICON_ROWS)
    return (f"SELECT DISTINCT lower(word) AS word, emotion FROM (VALUES {rows}) t(word, emotion, association) "
            f"WHERE association = 1 AND emotion IN ({', '.join(q(e) for e in K.EMOTIONS)})")


def lexicon_words() -> dict[str, list[str]]:
    """Inline lexicon after filtering, per emotion (for list membership)."""
    out: dict[str, set] = {e: set() for e in K.EMOTIONS}
    for w, e, a in FX.LEXICON_ROWS:
        if a == 1 and e in out:
            out[e].add(w.lower())
    return {e: sorted(v) for e, v in out.items()}


def enriched_cte(with_model: bool = True) -> str:
    key = "(CASE WHEN lang = 'fr' THEN 'fr' ELSE 'en' END)"
    star = weights_list(list(K.STAR_LABELS), 31, 7, 97)
    three = weights_list(list(K.THREE_CLASS_LABELS), 31, 7, 97)
    emo = weights_list(FX.EMOTION_MODEL_LABELS, 17, 3, 89)
    fail = f"post_id % {FX.FAILED_BATCH_MOD} = 0"
    sent_sums = ", ".join(
        f"list_reduce([CASE WHEN {unified_class('x.label', 'model_key')} = {q(c)} THEN x.score ELSE 0.0::DOUBLE END"
        f" for x in sentiment_raw], lambda a, b: a + b, 0.0::DOUBLE) AS s_{c}"
        for c in K.SENTIMENT_CLASSES)
    s = {c: f"s_{c}" for c in K.SENTIMENT_CLASSES}
    words = lexicon_words()
    hits = ", ".join(
        (f"CAST(len(list_filter(tokens, lambda t: list_contains({sql_list(words[e])}, t))) AS BIGINT)"
         if words[e] else "0") + f" AS h_{e}" for e in K.EMOTIONS)
    any_hit = " + ".join(f"h_{e}" for e in K.EMOTIONS) + " > 0"
    lex = ", ".join(f"CASE WHEN ({any_hit}) AND n_tokens > 0 THEN {rnd(f'h_{e} / n_tokens')} ELSE 0.0::DOUBLE END"
                    f" AS lex_{e}" for e in K.EMOTIONS)
    msum = ", ".join(
        f"coalesce(list_reduce([CASE WHEN {emotion_of('x.label')} = {q(e)} THEN x.score ELSE 0.0::DOUBLE END"
        f" for x in emotion_raw], lambda a, b: a + b, 0.0::DOUBLE), 0.0::DOUBLE) AS ms_{e}"
        for e in K.EMOTIONS)
    mtot = " + ".join(f"ms_{e}" for e in K.EMOTIONS)
    mscore = ", ".join(f"CASE WHEN m_tot > 0 THEN {rnd(f'ms_{e} / m_tot')} ELSE 0.0::DOUBLE END AS model_{e}"
                       for e in K.EMOTIONS)
    if with_model:
        comb = ", ".join(f"{rnd(f'{K.LEXICON_WEIGHT!r}::DOUBLE * coalesce(lex_{e}, 0.0::DOUBLE) + {K.MODEL_WEIGHT!r}::DOUBLE * coalesce(model_{e}, 0.0::DOUBLE)')}"
                         f" AS emotion_{e}" for e in K.EMOTIONS)
    else:
        comb = ", ".join(f"{rnd(f'coalesce(lex_{e}, 0.0::DOUBLE)')} AS emotion_{e}" for e in K.EMOTIONS)
    w = K.DISTRESS_WEIGHTS
    distress = rnd(f"({w['fear']!r}::DOUBLE * coalesce(emotion_fear, 0.0::DOUBLE) + {w['sadness']!r}::DOUBLE * "
                   f"coalesce(emotion_sadness, 0.0::DOUBLE) + {w['anger']!r}::DOUBLE * coalesce(emotion_anger, 0.0::DOUBLE))"
                   f" / {K.DISTRESS_DIVISOR!r}::DOUBLE")
    return clean_cte() + f""",
scored AS (
  SELECT *,
    CASE WHEN {fail} THEN NULL WHEN model_key = 'fr' THEN {star} ELSE {three} END AS sentiment_raw,
    CASE WHEN {fail} THEN NULL ELSE {emo} END AS emotion_raw
  FROM (SELECT *, {key} AS model_key FROM clean)),
sent0 AS (SELECT *, {sent_sums} FROM scored),
sent AS (
  SELECT * EXCLUDE ({', '.join(s.values())}),
    CASE WHEN sentiment_raw IS NOT NULL THEN {argmax_name(s, null_if_zero=False)} END AS sentiment_label,
    CASE WHEN sentiment_raw IS NOT NULL THEN {rnd(s['positive'])} END AS score_pos,
    CASE WHEN sentiment_raw IS NOT NULL THEN {rnd(s['neutral'])} END AS score_neu,
    CASE WHEN sentiment_raw IS NOT NULL THEN {rnd(s['negative'])} END AS score_neg,
    CASE WHEN sentiment_raw IS NOT NULL THEN {rnd(s['positive'] + ' - ' + s['negative'])} END AS score_cont
  FROM sent0),
lex0 AS (SELECT *, {hits} FROM sent),
lex1 AS (SELECT * EXCLUDE ({', '.join(f'h_{e}' for e in K.EMOTIONS)}), {lex} FROM lex0),
lex2 AS (SELECT *, {argmax_name({e: f'lex_{e}' for e in K.EMOTIONS})} AS lex_dominant FROM lex1),
mod0 AS (SELECT *, {msum} FROM lex2),
mod1 AS (SELECT *, {mtot} AS m_tot FROM mod0),
mod2 AS (SELECT * EXCLUDE (m_tot, {', '.join(f'ms_{e}' for e in K.EMOTIONS)}), {mscore} FROM mod1),
mod3 AS (SELECT *, {argmax_name({e: f'model_{e}' for e in K.EMOTIONS})} AS model_dominant FROM mod2),
comb0 AS (SELECT *, {comb} FROM mod3),
comb1 AS (SELECT *, {argmax_name({e: f'emotion_{e}' for e in K.EMOTIONS})} AS emotion_dominant,
  {distress} AS distress_score FROM comb0),
enriched AS (SELECT *, {distress_level('distress_score')} AS distress_level FROM comb1)"""
