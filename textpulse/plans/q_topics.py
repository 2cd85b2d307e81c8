"""Registered queries: n-grams, class-based TF-IDF, topic models, language id.

Class-based topics use the forum as the class over the topic-model input
(en / fr posts with at least five tokens)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.functions import text as TX
from textpulse.functions.numeric import grid_mean, rnd
from textpulse.operators import langid as LID
from textpulse.operators import topics as TP
from textpulse.plans import fixtures as FX
from textpulse.plans import sqlgen as S
from textpulse.plans.registry import register
from textpulse.plans.stages import clean_table
from textpulse.sources.readers import spread
from textpulse.sources.sinks import materialize

TI_CTE = f", ti AS (SELECT * FROM clean WHERE lang IN ('en', 'fr') AND n_tokens >= {K.MIN_TOKENS})"

CTFIDF_CTE = TI_CTE + """,
tt AS (SELECT forum AS topic, list_concat(tokens, [tokens[i] || ' ' || tokens[i + 1] for i in range(1, len(tokens))]) AS terms FROM ti),
voc AS (SELECT term FROM (SELECT unnest(list_distinct(terms)) AS term FROM tt) GROUP BY term
        HAVING count(*) >= {min_df} AND count(*) <= {max_df} * (SELECT count(*) FROM ti)),
tf AS (SELECT topic, term, count(*) AS tf FROM (SELECT topic, unnest(terms) AS term FROM tt)
       WHERE term IN (SELECT term FROM voc) GROUP BY 1, 2),
avgw AS (SELECT CAST(sum(tf) AS DOUBLE) / count(DISTINCT topic) AS a FROM tf),
w AS (SELECT topic, term, tf, sum(tf) OVER (PARTITION BY term) AS f FROM tf),
ww AS (SELECT topic, term, tf * ln(1 + (SELECT a FROM avgw) / f) AS weight FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM ww),
sizes AS (SELECT forum AS topic, count(*) AS cnt FROM ti GROUP BY 1),
ids AS (SELECT topic, CAST(row_number() OVER (ORDER BY cnt DESC, topic) - 1 AS INTEGER) AS topic_id, cnt FROM sizes),
words AS (SELECT topic, list(term ORDER BY rank) AS words, list(weight ORDER BY rank) AS weights
          FROM r WHERE rank <= 10 GROUP BY topic)""".format(min_df=K.NGRAM_MIN_DF, max_df=K.NGRAM_MAX_DF)


def _clean(select: str) -> str:
    return f"WITH {S.clean_cte()}{select}"


def _topic_input(spark, sf_dir, keep_order: bool = False):
    """Written once: the topic queries read it more than once. LDA is trained row
    by row and keeps the order in which a filter before ``spread`` leaves them, so
    there the tokens are settled only where ``spread`` deals no rows."""
    clean = clean_table(spark, sf_dir).select("post_id", "forum", "lang", "tokens", "n_tokens")
    docs = FX.read_table(spark, sf_dir, "documents")
    settle = not keep_order or spread(docs) is docs
    return materialize(spark, TP.topic_input(TX.settled(clean) if settle else clean).drop("n_tokens"), "topic-input")


@register("ngram_df_filter", sql=lambda: _clean(TI_CTE + f""",
terms AS (SELECT list_concat(tokens, [tokens[i] || ' ' || tokens[i + 1] for i in range(1, len(tokens))]) AS terms FROM ti),
dfq AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM terms) GROUP BY term)
SELECT term, df FROM dfq
WHERE df >= {K.NGRAM_MIN_DF} AND df <= {K.NGRAM_MAX_DF} * (SELECT count(*) FROM ti)"""))
def ngram_query(spark, sf_dir):
    """ML-4: uni+bi-gram document frequencies with the min_df / max_df rule."""
    return TP.ngram_doc_freq(_topic_input(spark, sf_dir)).select("term", "df")


@register("ctfidf_top_words", sql=lambda: _clean(CTFIDF_CTE + f"""
SELECT topic, CAST(rank AS INTEGER) AS rank, term, {S.rnd('weight')} AS weight FROM r WHERE rank <= 10"""))
def ctfidf_query(spark, sf_dir):
    """ML-5, WIN-4: class-based TF-IDF over the uni- and bigrams of the ML-4
    vocabulary, ten best terms per class."""
    ti = _topic_input(spark, sf_dir)
    tops = TP.top_words(TP.ctfidf(TP.class_term_counts(ti, "forum", vocabulary=TP.ngram_doc_freq(ti))))
    return tops.select("topic", F.col("rank").cast("int").alias("rank"), "term",
                       rnd("weight").alias("weight"))


@register("topic_labels", sql=lambda: _clean(CTFIDF_CTE + """,
lab AS (SELECT ids.topic, topic_id,
  CASE WHEN topic_id = -1 THEN 'outlier'
       WHEN coalesce(len(words[1:3]), 0) > 0 THEN 'T' || CAST(topic_id AS VARCHAR) || ': ' || array_to_string(words[1:3], ' | ')
       ELSE 'T' || CAST(topic_id AS VARCHAR) END AS topic_label
  FROM ids LEFT JOIN words ON words.topic = ids.topic)
SELECT ti.post_id, lab.topic_id, lab.topic_label FROM ti LEFT JOIN lab ON lab.topic = ti.forum"""))
def topic_labels_query(spark, sf_dir):
    """STR-17, JOI-3, ARR-4: topic id (by size) and label for every post."""
    ti = _topic_input(spark, sf_dir)
    topics = TP.topic_table(ti, "forum", vocabulary=TP.ngram_doc_freq(ti))
    return TP.assign_labels(ti, topics, "forum").select("post_id", "topic_id", "topic_label")


@register("topic_report", sql=lambda: _clean(CTFIDF_CTE + f"""
SELECT ids.topic_id, ids.cnt AS count,
  string_agg(r.term || ' (' || printf('%.3f', {S.rnd('r.weight', 3)}) || ')', ', ' ORDER BY r.rank) AS top_words
FROM ids JOIN r ON r.topic = ids.topic AND r.rank <= {K.TOPIC_REPORT_WORDS}
WHERE ids.topic_id <> -1 GROUP BY ids.topic_id, ids.cnt"""))
def topic_report_query(spark, sf_dir):
    """ML-8, FLT-7, STR-12, SNK-4: id, size and top-10 ``word (weight)``."""
    ti = _topic_input(spark, sf_dir)
    return TP.topic_report(TP.topic_table(ti, "forum", vocabulary=TP.ngram_doc_freq(ti)))


@register("topics_of_posts")
def topics_of_posts_query(spark, sf_dir):
    """ML-1..7, STR-17, JOI-3 end to end: discovered topic, probability and
    label of every post, -1 the outliers (rows-only check: iterative ML)."""
    posts, _ = TP.discover_topics(_topic_input(spark, sf_dir))
    return posts.select("post_id", "topic_id", "topic_prob", "topic_label")


@register("topics_found")
def topics_found_query(spark, sf_dir):
    """ML-8, FLT-7, AGG-16, AGG-17: report of the discovered topics with the
    share of assigned posts and the mean probability (rows-only check)."""
    posts, topics = TP.discover_topics(_topic_input(spark, sf_dir))
    posts = materialize(spark, posts.select("topic_id", "topic_prob"), "topics-of-posts")
    stats = posts.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_posts"), grid_mean("topic_prob").alias("mean_prob"))
    counters = posts.agg(F.struct(F.count_if(F.col("topic_id") == -1).alias("o"), F.count_if(F.col("topic_id") != -1).alias("a")).alias("c")).scalar()
    return (TP.topic_report(topics).join(stats, "topic_id").withColumn("_c", counters)
            .select("topic_id", "count", "top_words", "n_posts", "mean_prob", F.col("_c.o").alias("outliers"), F.col("_c.a").alias("assigned")))


@register("topic_clusters")
def topic_clusters_query(spark, sf_dir):
    """ML-1, ML-2, ML-3, ML-7: embeddings -> PCA(5) -> k-means topics with
    outliers (-1) and probabilities (rows-only check: iterative ML)."""
    emb = FX.read_table(spark, sf_dir, "embeddings")
    return TP.cluster_topics(emb, "embedding", "vec_id")


@register("topic_density")
def topic_density_query(spark, sf_dir):
    """ML-2, ML-3 by density: embeddings -> PCA(5) -> neighbours by random
    projections -> core points, their components and border points as topics,
    the rest -1 (rows-only check; a brute-force twin is in the tests)."""
    emb = FX.read_table(spark, sf_dir, "embeddings")
    return TP.density_topics(emb, "embedding", "vec_id")


@register("topic_merge")
def topic_merge_query(spark, sf_dir):
    """ML-6: merge forum topics by c-TF-IDF similarity down to four
    (rows-only check; brute force in the tests)."""
    ti = _topic_input(spark, sf_dir)
    return TP.merge_topics(ti, "forum", nr_topics=4)


@register("topic_similarity", sql=lambda: _clean(CTFIDF_CTE + f"""
SELECT x.topic AS a, y.topic AS b, {S.rnd('sum(x.weight * y.weight) / sqrt(any_value(x.n) * any_value(y.n))', 6)} AS similarity
FROM (SELECT *, sum(weight * weight) OVER (PARTITION BY topic) AS n FROM ww) x
JOIN (SELECT *, sum(weight * weight) OVER (PARTITION BY topic) AS n FROM ww) y ON x.term = y.term AND x.topic < y.topic
GROUP BY x.topic, y.topic"""))
def topic_similarity_query(spark, sf_dir):
    """ML-6: cosine similarities of all pairs of forum topics, by one self-join
    of their weighted terms."""
    ti = _topic_input(spark, sf_dir)
    d = materialize(spark, TP.topic_similarities(TP.class_term_counts(ti, "forum", vocabulary=TP.ngram_doc_freq(ti))), "similarities")
    norm = d.where("a = b").select(F.col("a").alias("t"), F.sqrt("dot").alias("n"))
    out = d.where("a <> b").join(norm.toDF("a", "_na"), "a").join(norm.toDF("b", "_nb"), "b")
    return out.select("a", "b", rnd(F.col("dot") / (F.col("_na") * F.col("_nb")), 6).alias("similarity"))


@register("topic_merge_auto")
def topic_merge_auto_query(spark, sf_dir):
    """ML-6 with nr_topics = -1: the number of topics by the largest fall in
    the merge tree (rows-only check; brute force in the tests)."""
    return TP.merge_topics(_topic_input(spark, sf_dir), "forum", nr_topics=-1)


@register("lda_topics")
def lda_query(spark, sf_dir):
    """ML-9: LDA topics over the topic-model input (rows-only check)."""
    ti = _topic_input(spark, sf_dir, keep_order=True)
    return TP.lda_topics(ti, "tokens", "post_id", k=K.NR_TOPICS)


@register("lda_report")
def lda_report_query(spark, sf_dir):
    """ML-9 with ML-8: report of the LDA topics with their words (rows-only
    check: iterative ML)."""
    ti = _topic_input(spark, sf_dir, keep_order=True)
    return TP.topic_report(TP.lda_model(ti, "tokens", "post_id", k=K.NR_TOPICS)[1])


@register("term_numbers", sql=lambda: _clean(TI_CTE + """,
t AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM ti) GROUP BY term)
SELECT term, df, row_number() OVER (ORDER BY df DESC, term) - 1 AS number FROM t"""))
def term_numbers_query(spark, sf_dir):
    """ML-9: dense numbers of all terms, by document frequency and term."""
    return TP.term_numbers(_topic_input(spark, sf_dir)).select("term", "df", "number")


def _langid_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, lang, text, lower(text) AS t FROM documents),
g AS (SELECT doc_id, lang, substr(t, i, 3) AS gram FROM (SELECT *, unnest(range(1, greatest(length(t) - 1, 1))) AS i FROM d)),
c AS (SELECT lang, gram, count(*) AS c FROM g WHERE lang IS NOT NULL GROUP BY ALL),
v AS (SELECT count(DISTINCT gram) AS v FROM c),
l AS (SELECT lang, sum(c) AS total FROM c GROUP BY lang),
p AS (SELECT lang, ln(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM d WHERE lang IS NOT NULL)) AS prior FROM d WHERE lang IS NOT NULL GROUP BY lang),
m AS (SELECT c.lang, c.gram, ln((c.c + 1.0) / (l.total + v)) - ln(1.0 / (l.total + v)) AS gain FROM c JOIN l USING (lang), v),
s AS (SELECT g.doc_id, m.lang, sum(m.gain) AS gain FROM (SELECT doc_id, gram FROM g) g JOIN m USING (gram) GROUP BY ALL),
a AS (SELECT d.doc_id, p.lang, p.prior + greatest(length(d.t) - 2, 0) * ln(1.0 / (l.total + v)) + coalesce(s.gain, 0) AS score
      FROM d, p JOIN l USING (lang), v LEFT JOIN s ON s.doc_id = d.doc_id AND s.lang = p.lang),
b AS (SELECT doc_id, lang AS lang_pred FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang DESC) = 1)
SELECT b.doc_id, lang_pred, CASE WHEN NOT {S.has_min_words('d.text', K.MIN_TOKENS)} THEN 'unknown'
  WHEN lang_pred IN ('en', 'fr') THEN lang_pred WHEN lang_pred IS NULL THEN 'unknown' ELSE 'other' END AS lang_detected
FROM b JOIN d USING (doc_id)"""


@register("langid_ngrams", sql=_langid_sql)
def langid_query(spark, sf_dir):
    """LID-1: character-trigram naive Bayes trained on the labelled
    documents, applied to every document, plus the post-rules
    (< 5 words -> unknown; en / fr kept; else other). A brute-force pandas
    twin is in the tests."""
    docs = FX.read_table(spark, sf_dir, "documents")
    model = LID.train(docs, text_col="text", label_col="lang")
    pred = LID.predict(docs, model, key="doc_id", text_col="text")
    return pred.select("doc_id", "lang_pred", "lang_detected")


@register("langid_compact", sql=_langid_sql)
def langid_compact_query(spark, sf_dir):
    """LID-1 with the weight table of fixed size: trained on the labelled
    documents, applied to every document where it is read."""
    docs = FX.read_table(spark, sf_dir, "documents")
    out = LID.predict_compact(spread(docs), LID.train_compact(docs))
    return out.select("doc_id", "lang_pred", "lang_detected")
