"""Topic operators (ML-1..9, WIN-4, STR-17, FLT-1, FLT-2, FLT-7, JOI-3, PRJ-10).

Term statistics are plain DataFrame work (explode -> groupBy -> window), so
they scale with the corpus. Per-topic tables (sizes, labels, c-TF-IDF top
words) are bounded by the number of topics, which is what lets them be
broadcast back onto the posts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, NGram, Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.functions.numeric import rnd
from textpulse.operators.blocks import deal, meet
from textpulse.operators.density import density_clusters
from textpulse.operators.lda import learn as online_lda
from textpulse.operators.numbering import number_rows
from textpulse.sources.sinks import materialize


WORDS_A_PART = 500_000
WORD_PASSES = 10  # of Word2Vec over all posts, however many there are


def topic_input(df: DataFrame, text_col: str = "text_clean", lemma_col: str = "text_lemma") -> DataFrame:
    """FLT-1, FLT-2, PRJ-10: en / fr posts with at least 5 tokens; the topic
    text is the lemma text when it is not blank, else the clean text (none
    where the frame has been pruned of the two)."""
    posts = df.filter(F.col("lang").isin("en", "fr") & (F.col("n_tokens") >= K.MIN_TOKENS))
    if not {text_col, lemma_col} <= set(df.columns):
        return posts
    lemma = F.col(lemma_col)
    return posts.withColumn("topic_text", F.when(F.trim(F.coalesce(lemma, F.lit(""))) != "", lemma).otherwise(F.col(text_col)))


def with_bigrams(df: DataFrame, tokens_col: str = "tokens", out_col: str = "terms") -> DataFrame:
    """Uni- and bi-grams of a token array (Spark ML ``NGram`` for the pairs)."""
    ng = NGram(n=2, inputCol=tokens_col, outputCol="_bigrams").transform(df)
    return ng.withColumn(out_col, F.concat(F.col(tokens_col), F.col("_bigrams"))).drop("_bigrams")


def ngram_doc_freq(df: DataFrame, tokens_col: str = "tokens", min_df: int = K.NGRAM_MIN_DF,
                   max_df: float = K.NGRAM_MAX_DF) -> DataFrame:
    """ML-4: document frequency of uni+bi-grams, kept when df >= min_df and
    df <= max_df * #documents (the CountVectorizer vocabulary rule)."""
    terms = with_bigrams(df.select(tokens_col), tokens_col)
    dfreq = (terms.select(F.explode(F.array_distinct("terms")).alias("term"))
                  .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    n_docs = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    # The bounds are checked on a struct of the aggregate, so that they aren't
    # pushed below it (a second count of everything).
    return (dfreq.select(F.struct("term", "df").alias("_t")).filter(F.col("_t.df") >= min_df)
                 .filter(F.col("_t.df") <= F.lit(max_df) * n_docs).select("_t.term", "_t.df"))


def class_term_counts(df: DataFrame, class_col: str, tokens_col: str = "tokens",
                      vocabulary: DataFrame | None = None) -> DataFrame:
    """tf(term, class): term occurrences per class. With a ``vocabulary`` (see
    ``ngram_doc_freq``) uni- and bigrams that it holds, else all unigrams."""
    if vocabulary is None:
        return (df.select(F.col(class_col).alias("topic"), F.explode(tokens_col).alias("term"))
                  .groupBy("topic", "term").agg(F.count(F.lit(1)).alias("tf")))
    both = with_bigrams(df.select(F.col(class_col).alias("topic"), tokens_col), tokens_col)
    tf = both.select("topic", F.explode("terms").alias("term")).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.join(vocabulary.select("term"), "term", "left_semi").select("topic", "term", "tf")


def ctfidf(tf: DataFrame) -> DataFrame:
    """ML-5: class-based TF-IDF, w(t, c) = tf(t, c) * ln(1 + A / f(t)) with
    f(t) the frequency of t over all classes and A the mean number of words
    per class (a scalar subquery). ``tf`` is (topic, term, tf)."""
    mean = tf.agg((F.sum("tf") / F.countDistinct("topic")).alias("a")).scalar()
    f_t = F.sum("tf").over(Window.partitionBy("term"))
    return (tf.withColumn("f", f_t).withColumn("_A", mean)
              .withColumn("weight", F.col("tf") * F.log(1.0 + F.col("_A") / F.col("f"))).drop("_A"))


def top_words(weights: DataFrame, k: int = K.TOPIC_REPORT_WORDS) -> DataFrame:
    """WIN-4: the k best terms per topic (weight desc, then term)."""
    w = Window.partitionBy("topic").orderBy(F.desc("weight"), F.col("term"))
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topic_ids_by_size(df: DataFrame, class_col: str) -> DataFrame:
    """Topic ids 0..n-1 by descending size (ties by class value). One row per
    class: bounded by the number of topics."""
    sizes = df.groupBy(F.col(class_col).alias("topic")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.orderBy(F.desc("count"), F.col("topic"))
    return sizes.withColumn("topic_id", (F.row_number().over(w) - 1).cast("int"))


def topic_label(topic_id: Column, words: Column, n_words: int = K.TOPIC_LABEL_WORDS) -> Column:
    """STR-17: -1 -> ``outlier``; ``T{id}: w1 | w2 | w3``; no words -> ``T{id}``."""
    head = F.slice(words, 1, n_words)
    base = F.concat(F.lit("T"), topic_id.cast("string"))
    return (F.when(topic_id == -1, F.lit("outlier"))
             .when(F.coalesce(F.size(head), F.lit(0)) > 0,
                   F.concat(base, F.lit(": "), F.array_join(head, " | ")))
             .otherwise(base))


def topic_table(df: DataFrame, class_col: str, tokens_col: str = "tokens",
                vocabulary: DataFrame | None = None, by_size: bool = True) -> DataFrame:
    """Per topic: id (by size; the class itself where it is a topic id), count,
    ordered top words and weights."""
    ids = topic_ids_by_size(df, class_col)
    if not by_size:
        ids = ids.withColumn("topic_id", F.col("topic").cast("int"))
    tops = top_words(ctfidf(class_term_counts(df, class_col, tokens_col, vocabulary)))
    words = (tops.groupBy("topic")
                 .agg(F.array_sort(F.collect_list(F.struct("rank", "term", "weight"))).alias("_w")))
    return (ids.join(words, "topic", "left")
               .select("topic", "topic_id", "count",
                       F.transform("_w", lambda x: x["term"]).alias("words"),
                       F.transform("_w", lambda x: x["weight"]).alias("weights")))


def assign_labels(df: DataFrame, topics: DataFrame, class_col: str) -> DataFrame:
    """JOI-3: topic id and label onto every post (one row per topic)."""
    lab = topics.select(F.col("topic").alias(class_col), "topic_id",
                        topic_label(F.col("topic_id"), F.col("words")).alias("topic_label"))
    return df.join(lab, class_col, "left")


def topic_report(topics: DataFrame, k: int = K.TOPIC_REPORT_WORDS) -> DataFrame:
    """ML-8 / FLT-7 / STR-12: id, count and ``word (0.123), ...`` for the top
    k words, outlier topic excluded."""
    pairs = F.transform(F.slice(F.arrays_zip("words", "weights"), 1, k),
                        lambda x: F.format_string("%s (%.3f)", x["words"], rnd(x["weights"], 3)))
    return (topics.where(F.col("topic_id") != -1)
                  .select("topic_id", "count", F.array_join(pairs, ", ").alias("top_words")))


# ---------------------------------------------------------------------------
# Model-based topics (embeddings -> reduced space -> clusters)
# ---------------------------------------------------------------------------

def reduced_vectors(df: DataFrame, vec_col: str, key: str, dims: int = K.REDUCED_DIMS) -> DataFrame:
    """ML-2: (key, x) with the vectors L2-normalised (cosine geometry) and
    reduced by PCA; written, since every clustering reads it several times.
    A null vector stays null."""
    vec = df.select(key, F.col(vec_col).cast("array<double>").alias("_a"))
    vec = materialize(df.sparkSession, vec, "topic-vectors")
    there = vec.where("_a IS NOT NULL").withColumn("_raw", array_to_vector("_a"))
    norm = Normalizer(inputCol="_raw", outputCol="_n", p=2.0).transform(there)
    pca = PCA(k=dims, inputCol="_n", outputCol="_r").fit(norm)
    red = pca.transform(norm).select(key, vector_to_array("_r").alias("x"))
    nothing = vec.where("_a IS NULL").select(key, F.lit(None).cast("array<double>").alias("x"))
    return materialize(df.sparkSession, red.unionByName(nothing), "topic-reduced")


def _ids_by_size(sizes: DataFrame, cluster: str, min_size: int) -> DataFrame:
    """(cluster, topic_id) for the clusters of at least ``min_size`` rows:
    0, 1, 2, ... by falling size. Clusters may be many, so they are numbered
    without a window over all of them."""
    able = sizes.where(F.col("_size") >= min_size)
    return number_rows(able, [F.desc("_size"), F.col(cluster)], "topic_id", "topic-sizes") \
        .select(cluster, F.col("topic_id").cast("int").alias("topic_id"))


def cluster_topics(df: DataFrame, vec_col: str, key: str, k: int = K.NR_TOPICS,
                   dims: int = K.REDUCED_DIMS, min_size: int = K.MIN_TOPIC_SIZE,
                   outlier_quantile: float = 0.95, seed: int = K.TOPIC_SEED) -> DataFrame:
    """ML-1..3, ML-7: reduced vectors, clustered with k-means. Points farther
    from their centre than the ``outlier_quantile`` of all distances, and
    clusters smaller than ``min_size``, become topic -1, as do null vectors.
    Remaining ids are re-ranked by size. ``topic_prob`` is the softmax of
    negative centre distances (its max)."""
    every = reduced_vectors(df, vec_col, key, dims)
    red = every.where("x IS NOT NULL").select(key, array_to_vector("x").alias("_r"))
    km = KMeans(k=k, seed=seed, featuresCol="_r", predictionCol="_c").fit(red)
    centres = [list(map(float, c)) for c in km.clusterCenters()]  # k x dims, bounded
    pts = km.transform(red).withColumn("_x", vector_to_array("_r"))
    cen = F.array(*[F.array(*[F.lit(v) for v in c]) for c in centres])
    dists = F.transform(cen, lambda c: F.sqrt(F.aggregate(
        F.zip_with(c, F.col("_x"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)))
    pts = pts.withColumn("_d", dists)
    pts = pts.withColumn("_dmin", F.array_min("_d"))
    expd = F.transform("_d", lambda d: F.exp(-d))
    pts = pts.withColumn("_prob", F.array_max(expd) / F.aggregate(expd, F.lit(0.0), lambda s, v: s + v))
    cut = pts.approxQuantile("_dmin", [outlier_quantile], 0.001)[0]
    pts = pts.withColumn("_c", F.when(F.col("_dmin") > cut, F.lit(-1)).otherwise(F.col("_c")))
    sizes = pts.where(F.col("_c") >= 0).groupBy("_c").agg(F.count(F.lit(1)).alias("_size"))
    out = pts.join(_ids_by_size(sizes, "_c", min_size), "_c", "left")
    lost = every.where("x IS NULL").select(key, F.lit(-1).alias("topic_id"), F.lit(None).cast("double").alias("topic_prob"))
    return out.select(key, F.coalesce("topic_id", F.lit(-1)).alias("topic_id"),
                      rnd("_prob").alias("topic_prob")).unionByName(lost)


def density_topics(df: DataFrame, vec_col: str, key: str, radius: float = K.DENSITY_RADIUS,
                   min_points: int = K.DENSITY_MIN_POINTS, dims: int = K.REDUCED_DIMS,
                   min_size: int = K.MIN_TOPIC_SIZE) -> DataFrame:
    """ML-3 by density: reduced vectors, clustered by ``density_clusters``.
    Noise, null vectors and clusters smaller than ``min_size`` are topic -1.
    ``topic_prob`` is 1 for a core point, falls to 0.5 for a point a whole
    radius away from its core point, and is 0 in topic -1."""
    found = density_clusters(reduced_vectors(df, vec_col, key, dims), "x", key, radius, min_points)
    found = materialize(df.sparkSession, found, "topic-density")
    sizes = found.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count(F.lit(1)).alias("_size"))
    out = found.join(_ids_by_size(sizes, "cluster", min_size), "cluster", "left")
    near = F.lit(1.0) - F.coalesce("distance", F.lit(0.0)) / (2 * radius)
    return out.select(key, F.coalesce("topic_id", F.lit(-1)).alias("topic_id"),
                      rnd(F.when(F.col("topic_id").isNull(), 0.0).otherwise(near)).alias("topic_prob"))


def term_numbers(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(term, number, df): every term once, numbered 0, 1, 2, ... by falling
    document frequency and then by term. Numbers are dealt by partition and
    place in it, so no vocabulary is gathered anywhere."""
    counted = (df.select(F.explode(F.array_distinct(tokens_col)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    return number_rows(counted, [F.desc("df"), F.col("term")], "number", "terms")


def term_counts(df: DataFrame, terms: DataFrame, key: str, tokens_col: str = "tokens") -> DataFrame:
    """(key, _c): each row's (number, n) by term number, null without tokens. A
    null key is one row."""
    counts = (df.select(F.col(key).alias("_key"), F.explode(tokens_col).alias("term")).groupBy("_key", "term").agg(F.count(F.lit(1)).alias("n"))
              .join(terms.select("term", "number"), "term"))
    rows = counts.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("number", "n"))).alias("_c"))  # a text's own distinct terms
    every = df.select(key)
    return every.join(rows, every[key].eqNullSafe(rows["_key"]), "left").select(key, "_c")


def count_vectors(df: DataFrame, terms: DataFrame, key: str, tokens_col: str = "tokens") -> DataFrame:
    """(key, features): sparse counts over the term numbers, for every row; a
    row without tokens has the zero vector. A null key is one row."""
    from pyspark.ml.linalg import Vectors, VectorUDT
    size = max(1, terms.count())
    sparse = F.udf(lambda c: Vectors.sparse(size, [x["number"] for x in c or ()], [float(x["n"]) for x in c or ()]), VectorUDT())
    return term_counts(df, terms, key, tokens_col).select(key, sparse("_c").alias("features"))


#: Topics times terms up to which Spark ML's LDA, whose topics are matrices at
#: the driver and in each task, is used (some 64 MB a matrix).
LDA_LOCAL_CELLS = 1 << 23


def lda_model(df: DataFrame, tokens_col: str, key: str, k: int = K.NR_TOPICS, seed: int = K.TOPIC_SEED, max_iter: int = 20,
              n_words: int = K.TOPIC_REPORT_WORDS, local_cells: int = LDA_LOCAL_CELLS) -> tuple[DataFrame, DataFrame]:
    """ML-9: LDA over the counts of all terms. Returns (key, topic_id,
    topic_prob) with each row's dominant topic (-1 without tokens), and the
    topics as ``topic_table`` gives them: topic, topic_id, count, words and
    weights, the heaviest terms named by the term numbers.

    Online variational Bayes: Spark ML's up to ``local_cells`` topics times
    terms, beyond that the same method with the topics in a table (``lda``)."""
    spark = df.sparkSession
    terms = term_numbers(df, tokens_col)
    if k * terms.count() <= local_cells:
        feats = materialize(spark, count_vectors(df, terms, key, tokens_col), "lda-counts")
        model = LDA(k=k, seed=seed, maxIter=max_iter, featuresCol="features", topicDistributionCol="_td").fit(feats)
        p = model.transform(feats).withColumn("_p", vector_to_array("_td"))
        best = F.array_max("_p")
        found = p.select(key, F.when(best > 0, F.array_position("_p", best).cast("int") - 1).otherwise(-1).alias("topic_id"),
                         F.when(best > 0, rnd(best)).alias("topic_prob"))
        described = model.describeTopics(n_words).select("topic", F.inline(F.arrays_zip(F.col("termIndices").alias("number"), F.col("termWeights").alias("weight"))))  # k x n_words rows
    else:
        docs = term_counts(df, terms, key, tokens_col).select(key, F.col("_c.number").alias("numbers"), F.col("_c.n").alias("counts"))
        model = online_lda(materialize(spark, docs, "lda-counts"), terms, k, seed, max_iter)
        found = model.found(key).select(key, F.coalesce("topic", F.lit(-1)).alias("topic_id"), rnd("weight").alias("topic_prob"))
        described = model.described(n_words)
    found = materialize(spark, found, "lda-topics")
    named = described.join(terms, "number").groupBy("topic") \
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("order"), "term", "weight"))).alias("_w"))
    sizes = found.groupBy("topic_id").agg(F.count(F.lit(1)).alias("count"))
    topics = named.join(sizes, F.col("topic") == F.col("topic_id"), "left").select(
        "topic", F.col("topic").cast("int").alias("topic_id"), F.coalesce("count", F.lit(0)).alias("count"),
        F.transform("_w", lambda x: x["term"]).alias("words"), F.transform("_w", lambda x: x["weight"]).alias("weights"))
    return found, topics


def lda_topics(df: DataFrame, tokens_col: str, key: str, k: int = K.NR_TOPICS, seed: int = K.TOPIC_SEED, max_iter: int = 20) -> DataFrame:
    """ML-9: dominant LDA topic and its weight for every row."""
    return lda_model(df, tokens_col, key, k, seed, max_iter)[0]


def topic_similarities(tf: DataFrame) -> DataFrame:
    """(a, b, dot) for topics a <= b that share a term: scalar products of
    their class-based TF-IDF vectors, by one self-join on the term."""
    w = ctfidf(tf).select("topic", "term", "weight")
    other = w.select(F.col("topic").alias("b"), "term", F.col("weight").alias("_wb"))
    return (w.withColumnRenamed("topic", "a").join(other, "term").where(F.col("a") <= F.col("b"))
             .groupBy("a", "b").agg(F.sum(F.col("weight") * F.col("_wb")).alias("dot")))


def merge_order(sizes: dict, dots: dict) -> list[tuple]:
    """(from, into, similarity) of each merge down to one topic: the smallest
    topic goes into its most similar one (cosine; without a shared term the
    largest). Term weights stay those of the topics found, so a merged topic's
    vector is the sum and its products are sums of products."""
    names = sorted(sizes, key=str)
    dot = {a: {b: dots.get((a, b), dots.get((b, a), 0.0)) for b in names} for a in names}
    size, out = dict(sizes), []
    while len(size) > 1:
        small = min(size, key=lambda t: (size[t], str(t)))
        others = [t for t in size if t != small]
        cosine = lambda t: dot[small][t] / math.sqrt(dot[small][small] * dot[t][t]) if dot[small][t] > 0 else 0.0
        best = max(cosine(t) for t in others)
        into = min((t for t in others if cosine(t) == best), key=str) if best > 0 else min(others, key=lambda t: (-size[t], str(t)))
        out.append((small, into, best))
        own = dot[into][into] + 2 * dot[small][into] + dot[small][small]
        for t in others:
            if t != into:
                dot[into][t] = dot[t][into] = dot[into][t] + dot[small][t]
        dot[into][into] = own
        size[into] += size.pop(small)
    return out


def automatic_number(merges: list[tuple], topics: int) -> int:
    """Where the merge tree is cut if no number is given: before the merge
    with the largest fall in similarity against the one before it (at least
    two topics stay; without any fall, all)."""
    falls = [(merges[i - 1][2] - merges[i][2], -i) for i in range(1, len(merges) - 1)]
    best = max(falls, default=(0.0, 0))
    return topics + best[1] if best[0] > 0 else topics


def merge_topics(df: DataFrame, class_col: str, nr_topics: int, tokens_col: str = "tokens", outlier=None) -> DataFrame:
    """ML-6: reduce the topics to ``nr_topics`` (see ``merge_order``); -1
    chooses the number by ``automatic_number``. Rows of class ``outlier`` are
    no topic and stay apart.

    Two jobs whatever the number of merges: the term counts of each class,
    written, and the products of all pairs of topics. The driver holds those, a
    number for each pair of topics. Returns (original class, merged topic id by
    size; -1 for the outliers)."""
    spark = df.sparkSession
    posts = df if outlier is None else df.where(~F.col(class_col).eqNullSafe(F.lit(outlier)))
    tf = materialize(spark, class_term_counts(posts, class_col, tokens_col), "merge-tf")
    sizes = {r["topic"]: r["count"] for r in topic_ids_by_size(posts, class_col).select("topic", "count").collect()}
    kind = df.schema[class_col].dataType.simpleString()
    dots = {(r["a"], r["b"]): r["dot"] for r in topic_similarities(tf).collect()}
    merges = merge_order(sizes, dots)
    left = len(sizes) if nr_topics == 0 else automatic_number(merges, len(sizes)) if nr_topics < 0 else min(nr_topics, len(sizes))
    mapping = {t: t for t in sizes}
    for small, into, _ in merges[: len(sizes) - left]:
        mapping = {o: into if t == small else t for o, t in mapping.items()}
    total = {t: sum(sizes[o] for o, x in mapping.items() if x == t) for t in set(mapping.values())}
    order = {t: i for i, t in enumerate(sorted(total, key=lambda t: (-total[t], str(t))))}
    rows = [(o, order[t]) for o, t in mapping.items()] + ([] if outlier is None else [(outlier, -1)])
    return spark.createDataFrame(rows, f"{class_col} {kind}, topic_id int")


def text_vectors(df: DataFrame, tokens_col: str = "tokens", key: str = "post_id", dims: int = 256) -> DataFrame:
    """(key, vector): hashed, IDF-weighted term counts, all in the JVM and without
    training: the quick alternative to ``learned_vectors``."""
    tf = HashingTF(inputCol=tokens_col, outputCol="_tf", numFeatures=dims).transform(df.select(key, tokens_col))
    return IDF(inputCol="_tf", outputCol="_v").fit(tf).transform(tf).select(key, vector_to_array("_v").alias("vector"))


def training_parts(words: int) -> int:
    """Into how many parts Word2Vec deals its sentences, each trained by one
    task an iteration: by their words, since posts may be of any length."""
    return max(1, min(64, words // WORDS_A_PART))


def learned_vectors(df: DataFrame, tokens_col: str = "tokens", key: str = "post_id", dims: int = K.EMBEDDING_DIMS,
                    min_count: int = K.NGRAM_MIN_DF, smooth: float = 1e-3, seed: int = K.TOPIC_SEED) -> DataFrame:
    """ML-1: (key, vector) from word vectors that are learnt on these posts.

    Spark ML's Word2Vec learns a vector for each word that occurs ``min_count``
    times, in ``WORD_PASSES`` passes over all posts, dealt and sorted by key so that
    the result doesn't go by the order that they come in. A post's vector is the
    mean of its words' vectors, each weighted by smooth / (smooth + the word's share of all words), so frequent words count
    little; then what all posts have in common, the first direction of their
    second moments (a ``dims`` x ``dims`` matrix summed in tasks), is taken out.
    A post without a known word has the zero vector; a null key is one row."""
    spark = df.sparkSession
    posts = df.select(F.col(key).alias("_key"), F.coalesce(tokens_col, F.array().cast("array<string>")).alias("_tokens"))
    counted = materialize(spark, posts.select(F.explode("_tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "vector-words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    zero = F.array_repeat(F.lit(0.0), dims)
    if counted.where(F.col("n") >= min_count).isEmpty():
        return df.select(key, zero.alias("vector"))
    parts = training_parts(total)
    dealt = posts.repartition(parts, F.xxhash64("_key")).sortWithinPartitions("_key", "_tokens")
    posts = materialize(spark, deal(dealt.withColumn("uid", F.monotonically_increasing_id()), total), "vector-tokens")
    model = Word2Vec(vectorSize=dims, minCount=min_count, windowSize=5, maxIter=WORD_PASSES, numPartitions=parts, seed=seed,
                     inputCol="_tokens", outputCol="_v").fit(posts.select("_tokens"))
    weight = F.lit(smooth) / (F.lit(smooth) + F.col("n") / F.lit(float(total)))
    found = model.getVectors().select("word", vector_to_array("vector", "float32").alias("vector"))  # Word2Vec's own numbers are floats
    vectors = materialize(spark, found.join(counted, "word").select("word", "vector", weight.alias("_w")), "word-vectors")

    def means(texts: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """Each text's mean vector and what its words weigh together."""
        tokens, sizes = np.concatenate(texts["_tokens"].to_list()), texts["_tokens"].map(len).to_numpy()
        place = pd.Index(rows["word"]).get_indexer(tokens)
        known = place >= 0
        text, place = np.repeat(np.arange(len(texts)), sizes)[known], place[known]
        x = np.stack(rows["vector"].to_list()).T.copy() if len(rows) else np.zeros((dims, 0))
        w = rows["_w"].to_numpy(float)[place]
        share = np.bincount(text, w, len(texts))
        out = np.column_stack([np.bincount(text, w * x[i][place], len(texts)) for i in range(dims)])
        there = share > 0
        return pd.DataFrame({"_key": texts["_key"][there], "_m": list(out[there] / share[there, None]), "_share": share[there]})

    kind = df.schema[key].dataType.simpleString()
    each = meet(posts.where("size(_tokens) > 0"), "_tokens", vectors, "word", "inner", means, f"_key {kind}, _m array<double>, _share double")
    mean = each.groupBy("_key").agg(Summarizer.mean(array_to_vector("_m"), F.col("_share")).alias("_m"))  # a key's texts together
    mean = materialize(spark, mean.select("_key", vector_to_array("_m").alias("_m")), "post-means")

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((dims, dims))
        for b in batches:
            if len(b):
                x = np.stack(b["_m"].to_list())
                out += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(dims), dims), "j": np.tile(np.arange(dims), dims), "s": out.ravel()})

    second = np.zeros((dims, dims))
    for r in mean.select("_m").mapInPandas(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # dims x dims rows
        second[r["i"], r["j"]] = r["s"]
    common = np.linalg.eigh(second)[1][:, -1]
    direction = F.array(*[F.lit(float(c)) for c in common])
    along = F.aggregate(F.zip_with("_m", direction, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    clean = F.zip_with("_m", F.transform(direction, lambda c: c * F.col("_along")), lambda a, b: a - b)
    own = mean.withColumn("_along", along).select("_key", clean.alias("_vector"))
    out = df.select(key)
    return out.join(own, out[key].eqNullSafe(own["_key"]), "left").select(key, F.coalesce("_vector", zero).alias("vector"))


def discover_topics(df: DataFrame, key: str = "post_id", tokens_col: str = "tokens", vectors: DataFrame | None = None,
                    k: int = K.NR_TOPICS, min_size: int = K.MIN_TOPIC_SIZE, cluster=None) -> tuple[DataFrame, DataFrame]:
    """ML-1..8 end to end: cluster the posts' vectors, take the vocabulary of
    uni- and bigrams, weigh it per cluster, label the clusters and put topic
    id, probability and label on every post (a null key is one post, as in the
    clean stage; a post without a vector is an outlier). Topic -1 holds the
    outliers. ``cluster`` takes (vectors, vector column, key) and gives (key,
    topic_id, topic_prob); by default k-means with ``k`` clusters. Returns
    (posts with topic columns, topic table). ``df`` is read several times: pass
    a written table."""
    if vectors is None:
        vectors = learned_vectors(df, tokens_col, key)
    found = cluster(vectors, "vector", key) if cluster else cluster_topics(vectors, "vector", key, k=k, min_size=min_size)
    found = found.withColumnRenamed(key, "_key")
    posts = df.drop("topic_id", "topic_prob", "topic_label")
    posts = posts.join(found, posts[key].eqNullSafe(found["_key"]), "left").drop("_key").withColumn("topic_id", F.coalesce("topic_id", F.lit(-1)))
    posts = materialize(df.sparkSession, posts, "topic-posts")
    topics = topic_table(posts, "topic_id", tokens_col, ngram_doc_freq(df, tokens_col), by_size=False)
    topics = materialize(df.sparkSession, topics, "topic-table")
    labelled = posts.join(topics.select("topic_id", topic_label(F.col("topic_id"), F.col("words")).alias("topic_label")), "topic_id")
    return labelled, topics
