"""Language identification (LID-1) as Spark jobs.

A character-trigram naive Bayes model:

* train: explode the trigrams of every labelled text -> count per
  (language, trigram) -> add-one smoothed log-probabilities;
* predict: explode the trigrams of every text -> count per (text, trigram)
  -> join the model, one row per trigram -> per-language
  sums -> argmax, then the analysed post-rules (fewer than five words ->
  ``unknown``; en / fr kept; any other language -> ``other``).

``train_compact`` and ``predict_compact`` are the same model over hashed
trigrams: a weight table of fixed size that every task holds, so texts are
scored where they are read and no trigram is shuffled. ``predict`` with its
exact join is the checked alternative.

Whole texts are used. The per-language constants (prior, unseen-trigram
log-probability) form a table with one row per language, which is the only
thing brought to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.functions.text import has_min_words


def char_grams(col, n: int = 3) -> Column:
    """All overlapping character n-grams of the lower-cased text.

    A zero-width look-ahead capturing ``n`` characters matches at every
    position, so one compiled regex pass returns every gram (no per-gram
    substring scan, no interpreted lambda)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(c), F.lit("(?s)(?=(.{%d}))" % n), F.lit(1))


def n_char_grams(col, n: int = 3) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.greatest(F.length(c) - (n - 1), F.lit(0))


@dataclass
class LangModel:
    logp: DataFrame          # (lang, gram, logp)
    langs: list[str]
    prior: dict[str, float]
    unseen: dict[str, float]
    n: int = 3


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", n: int = 3) -> LangModel:
    from textpulse.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(docs.sparkSession)  # the cluster's folder; own one only if unset
    lab = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = (lab.select(F.col(label_col).alias("lang"), F.explode(char_grams(text_col, n)).alias("gram"))
                 .groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c")))
    # Reused three times below: written once as Parquet under the checkpoint
    # folder (one computation, columnar re-reads, survives executor loss).
    from textpulse.sources.sinks import materialize
    counts = materialize(docs.sparkSession, counts, "langid-counts")
    vocab = counts.select("gram").distinct().count()
    per_lang = counts.groupBy("lang").agg(F.sum("c").alias("total")).collect()   # one row per language
    docs_per_lang = {r["lang"]: r["cnt"] for r in
                     lab.groupBy(F.col(label_col).alias("lang")).agg(F.count(F.lit(1)).alias("cnt")).collect()}
    n_docs = sum(docs_per_lang.values())
    totals = {r["lang"]: int(r["total"]) for r in per_lang}
    langs = sorted(totals)
    prior = {lg: math.log(docs_per_lang[lg] / n_docs) for lg in langs}
    unseen = {lg: math.log(1.0 / (totals[lg] + vocab)) for lg in langs}
    denom = F.lit(0.0)
    for lg in langs:
        denom = F.when(F.col("lang") == lg, F.lit(float(totals[lg] + vocab))).otherwise(denom)
    logp = counts.select("lang", "gram", F.log((F.col("c") + 1.0) / denom).alias("logp"))
    return LangModel(logp=logp, langs=langs, prior=prior, unseen=unseen, n=n)


def predict(docs: DataFrame, model: LangModel, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    # Every trigram occurrence meets one model row with a gain per language;
    # all occurrences of a text sit in one partition, so the per-text sums
    # combine map-side and only one partial row per text is shuffled.
    grams = docs.select(key, F.explode(char_grams(text_col, model.n)).alias("gram"))
    gains = model.logp.groupBy("gram").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == lg, F.col("logp") - F.lit(model.unseen[lg]))), F.lit(0.0))
                                             .alias(f"_g_{lg}") for lg in model.langs])  # one row per trigram
    matched = grams.join(gains, "gram").groupBy(key).agg(*[F.sum(f"_g_{lg}").alias(f"_m_{lg}") for lg in model.langs])
    n_grams = n_char_grams(text_col, model.n)
    base = docs.select(key, n_grams.alias("_n"),
                       has_min_words(text_col, K.MIN_TOKENS).alias("_enough"))
    j = base.join(matched.withColumnRenamed(key, "_match"), F.col(key).eqNullSafe(F.col("_match")), "left").drop("_match")
    scores = F.array(*[F.struct(
        (F.lit(model.prior[lg]) + F.col("_n") * F.lit(model.unseen[lg])
         + F.coalesce(F.col(f"_m_{lg}"), F.lit(0.0))).alias("s"), F.lit(lg).alias("lang"))
        for lg in model.langs])
    best = F.array_max(scores)["lang"]   # max by score, ties by language name
    detected = (F.when(~F.col("_enough"), F.lit("unknown"))
                 .when(F.col("lang_pred").isin("en", "fr"), F.col("lang_pred"))
                 .when(F.col("lang_pred").isNull(), F.lit("unknown"))
                 .otherwise(F.lit("other")))
    return j.withColumn("lang_pred", best).withColumn("lang_detected", detected) \
            .drop("_n", "_enough", *[f"_m_{lg}" for lg in model.langs])


BITS = 20


@dataclass
class CompactModel:
    langs: list[str]
    prior: np.ndarray       # per language
    unseen: np.ndarray      # log-probability of a trigram that the language doesn't have
    gain: np.ndarray        # (2^bits, languages): what a trigram adds to that
    bits: int = BITS


def gram_codes(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A number below 2^bits for each character trigram of the texts, and for
    each text the place of its first, with one more for the end."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for t in texts]
    sizes = np.array([max(0, len(r) - 2) for r in raw], np.int64)
    out = np.empty(int(sizes.sum()), np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    shift = np.uint64(64 - bits)
    for r, i, j in zip(raw, ends, ends[1:]):
        if j > i:
            # Three code points of 21 bits each; the product's upper bits mix them.
            x = (r[:-2] << np.uint64(42) | r[1:-1] << np.uint64(21) | r[2:]) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            out[i:j] = (x >> shift).astype(np.int64)
    return out, ends


def _lowered(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.coalesce(F.lower(F.col(text_col)), F.lit("")).alias("_text"))


def train_compact(docs: DataFrame, text_col: str = "text", label_col: str = "lang", bits: int = BITS) -> CompactModel:
    """Counts per (language, hashed trigram) are summed in each task and then
    by Spark; the driver holds the table, 2^bits numbers a language at most."""
    lab = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    per_lang = {r["lang"]: r["n"] for r in lab.groupBy(F.col(label_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    langs = sorted(per_lang)
    number = {lg: i for i, lg in enumerate(langs)}

    def count(batches):
        total = {}
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.iloc[i : i + 500]
                code, at = gram_codes(part["_text"].tolist(), bits)
                lang = np.repeat(part["_lang"].map(number).to_numpy(), np.diff(at))
                for lg in np.unique(lang):
                    n = total.setdefault(int(lg), np.zeros(1 << bits, np.int64))
                    n += np.bincount(code[lang == lg], minlength=1 << bits)
        for lg, n in total.items():
            there = np.flatnonzero(n)
            yield pd.DataFrame({"lang": np.int32(lg), "gram": there.astype(np.int32), "n": n[there]})

    found = _lowered(lab, text_col, F.col(label_col).alias("_lang")).mapInPandas(count, "lang int, gram int, n long")
    rows = found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 << bits, len(langs)))
    counts[rows["gram"], rows["lang"]] = rows["n"]
    vocab, totals = int((counts.sum(1) > 0).sum()), counts.sum(0)
    unseen = np.log(1.0 / (totals + vocab)) if langs else np.zeros(0)
    gain = np.where(counts > 0, np.log((counts + 1.0) / (totals + vocab)) - unseen, 0.0) if langs else counts
    n_docs = sum(per_lang.values())
    return CompactModel(langs, np.log([per_lang[lg] / n_docs for lg in langs]), unseen, gain, bits)


def predict_compact(docs: DataFrame, model: CompactModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_detected``: narrow, one row for
    each row, in place."""
    langs, bits = np.array(model.langs, object), model.bits
    held = docs.sparkSession.sparkContext.broadcast((model.prior, model.unseen, model.gain))

    def label(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            prior, unseen, gain = held.value
            out = []
            for i in range(0, len(t), 500):
                code, at = gram_codes(t.iloc[i : i + 500].tolist(), bits)
                n = np.diff(at)
                score = prior + n[:, None] * unseen
                if len(code):
                    there = n > 0
                    score[there] += np.add.reduceat(gain[code], at[:-1][there], axis=0)
                # The greatest score; ties by the greater name, as in ``predict``.
                best = score.shape[1] - 1 - score[:, ::-1].argmax(1) if len(langs) else np.zeros(len(score), int)
                out += langs[best].tolist() if len(langs) else [None] * len(score)
            yield pd.Series(out, dtype=object)

    text = F.coalesce(F.lower(F.col(text_col)), F.lit(""))
    pred = F.pandas_udf(label, "string")(text)
    enough = has_min_words(text_col, K.MIN_TOKENS)
    out = docs.withColumn("lang_pred", pred)
    detected = (F.when(~enough, F.lit("unknown")).when(F.col("lang_pred").isin("en", "fr"), F.col("lang_pred"))
                 .when(F.col("lang_pred").isNull(), F.lit("unknown")).otherwise(F.lit("other")))
    return out.withColumn("lang_detected", detected)


def detector(model: LangModel | CompactModel, key: str = "post_id"):
    """Adapter for ``cleaning.clean_posts(detector=...)``: adds
    ``lang_detected`` computed on the clean text; with a compact model in
    place, without a join."""
    if isinstance(model, CompactModel):
        return lambda df, text_col: predict_compact(df.drop("lang_detected"), model, text_col).drop("lang_pred")

    def run(df: DataFrame, text_col: str) -> DataFrame:
        pred = predict(df.select(key, text_col), model, key=key, text_col=text_col)
        found = pred.select(F.col(key).alias("_key"), F.col("lang_detected").alias("_detected"))
        return (df.drop("lang_detected").join(found, df[key].eqNullSafe(found["_key"]), "left").drop("_key")
                  .withColumnRenamed("_detected", "lang_detected"))
    return run
