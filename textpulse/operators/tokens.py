"""Token operators beyond the column functions (TOK-2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.operators.blocks import deal, meet

LONGEST_SUFFIX = 6
LEAST_SUPPORT = 2
LEAST_SHARE = 0.5


def _common_prefix(a: str, b: str) -> Column:
    """Characters that two strings begin with alike."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col(a), i, F.lit(1)) == F.substring(F.col(b), i, F.lit(1)))
    differs = F.array_position(same, F.lit(False))
    return F.when(n == 0, 0).when(differs == 0, n).otherwise(differs - 1).cast("int")


def lemma_rules(dictionary: DataFrame, longest: int = LONGEST_SUFFIX, support: int = LEAST_SUPPORT, share: float = LEAST_SHARE) -> DataFrame:
    """TOK-2: suffix rules learnt from a (lang, form, lemma) table.

    An entry's edit takes the end that the form doesn't share with its lemma and
    puts the lemma's end there. Each ending of the form that holds the edit, up
    to ``longest`` characters, votes for it. A rule is an ending's most frequent
    edit (ties: the shorter cut, then the smaller end), kept if it has
    ``support`` votes and ``share`` of the ending's. Returns (lang, suffix, cut,
    add, votes)."""
    d = dictionary.where("form IS NOT NULL AND lemma IS NOT NULL AND form <> ''").select("lang", "form", "lemma").dropDuplicates(["lang", "form"])
    p = d.withColumn("_p", _common_prefix("form", "lemma"))
    cut, add = (F.length("form") - F.col("_p")).cast("int"), F.expr("substr(lemma, _p + 1)")
    p = p.withColumns({"cut": cut, "add": add, "_long": F.least(F.length("form"), F.lit(longest))})
    ends = p.where(F.col("_long") >= F.greatest(F.col("cut"), F.lit(1))) \
        .withColumn("_k", F.explode(F.sequence(F.greatest(F.col("cut"), F.lit(1)), F.col("_long")))) \
        .withColumn("suffix", F.expr("substr(form, length(form) - _k + 1)"))
    votes = ends.groupBy("lang", "suffix", "cut", "add").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("lang", "suffix").agg(F.sum("votes").alias("_all"), F.min(F.struct((-F.col("votes")).alias("v"), "cut", "add")).alias("_b"))
    kept = best.where((-F.col("_b.v") >= support) & (-F.col("_b.v") >= share * F.col("_all")))
    return kept.select("lang", "suffix", "_b.cut", "_b.add", (-F.col("_b.v")).alias("votes"))


def lemmas_of_forms(forms: DataFrame, dictionary: DataFrame, rules: DataFrame, longest: int = LONGEST_SUFFIX) -> DataFrame:
    """(lang, form, lemma, source) for each distinct (lang, form): by the
    dictionary, else by the rule with the longest ending that leaves a
    character, else the form itself. Works on distinct forms, so its shuffles
    grow with the vocabulary, not with the tokens."""
    known = dictionary.where("form IS NOT NULL AND lemma IS NOT NULL").select("lang", "form", "lemma").dropDuplicates(["lang", "form"])
    each = forms.where("form IS NOT NULL AND lang IS NOT NULL").select("lang", "form").distinct().join(known, ["lang", "form"], "left")
    new = each.where("lemma IS NULL").select("lang", "form")
    ends = new.where("form <> ''").withColumn("_k", F.explode(F.sequence(F.lit(1), F.least(F.length("form"), F.lit(longest))))) \
        .withColumn("suffix", F.expr("substr(form, length(form) - _k + 1)"))
    made = F.concat(F.expr("substr(form, 1, length(form) - cut)"), F.col("add"))
    hits = ends.join(rules, ["lang", "suffix"]).withColumn("_made", made).where(F.col("_made") != "")
    ruled = hits.groupBy("lang", "form").agg(F.max_by("_made", "_k").alias("_ruled"))
    out = each.join(ruled, ["lang", "form"], "left")
    source = F.when(F.col("lemma").isNotNull(), "dictionary").when(F.col("_ruled").isNotNull(), "rule").otherwise("form")
    return out.select("lang", "form", F.coalesce("lemma", "_ruled", "form").alias("lemma"), source.alias("source"))


def lemma_table(df: DataFrame, dictionary: DataFrame, tokens_col: str = "tokens", lang_col: str = "lang", **how) -> DataFrame:
    """A (lang, form, lemma) table of all tokens of ``df`` for ``lemmatize``,
    unseen forms by rules that are learnt from ``dictionary``."""
    forms = df.select(F.col(lang_col).alias("lang"), F.explode(tokens_col).alias("form"))
    return lemmas_of_forms(forms, dictionary, lemma_rules(dictionary, **how)).select("lang", "form", "lemma")


def lemmatize(df: DataFrame, dictionary: DataFrame, key: str = "post_id",
              tokens_col: str = "tokens", lang_col: str = "lang",
              out_col: str = "lemmas") -> DataFrame:
    """TOK-2: replace each token by its dictionary lemma (``coalesce`` to the
    form), keeping token order.

    ``dictionary`` is a ``(lang, form, lemma)`` table of any size; how it is
    joined is the planner's matter. Tokens are
    exploded with their position, joined, and re-collected per post; the
    group is one post's tokens, and the input is already hash-partitioned by
    ``key`` after the clean stage, so the re-collect adds no exchange.
    Returns ``key``, ``lang`` and the lemma array.
    """
    d = dictionary.select(F.col("lang").alias("_dlang"), F.col("form").alias("_form"),
                          F.col("lemma").alias("_lemma")).dropDuplicates(["_dlang", "_form"])
    exploded = df.select(key, lang_col, F.posexplode_outer(tokens_col).alias("_pos", "_tok"))
    joined = exploded.join(d,
                           (F.col("_dlang") == F.col(lang_col)) & (F.col("_form") == F.col("_tok")),
                           "left")
    item = F.when(F.col("_tok").isNotNull(),
                  F.struct(F.col("_pos").alias("p"), F.coalesce("_lemma", "_tok").alias("l")))
    grouped = joined.groupBy(key, lang_col).agg(F.collect_list(item).alias("_items"))
    return grouped.select(key, lang_col,
                          F.transform(F.array_sort("_items"), lambda x: x["l"]).alias(out_col))


def lemma_texts(df: DataFrame, dictionary: DataFrame, key: str = "post_id", tokens_col: str = "tokens",
                lang_col: str = "lang", out_col: str = "text_lemma") -> DataFrame:
    """TOK-2 in place: ``df`` with each row's own lemmas, joined by spaces, as
    ``out_col``. The tokens travel as they lie in their rows, and a block of rows
    gets each of its (lang, form) pairs once (``blocks``). ``df`` is read three
    times: pass a written table."""
    d = dictionary.where("lang IS NOT NULL AND form IS NOT NULL").dropDuplicates(["lang", "form"]) \
        .select(F.struct("lang", "form").alias("_pair"), "lemma")
    carried = [c for c in df.columns if c != out_col]
    schema = df.select(*carried, F.lit("").alias(out_col)).schema
    total = df.agg(F.sum(F.greatest(F.size(tokens_col), F.lit(0)))).first()[0] or 0
    rows = deal(df.select(F.struct(*carried).alias("row"), F.xxhash64(key, tokens_col).alias("uid")), total)
    pairs = F.transform(F.col("row")[tokens_col], lambda t: F.struct(F.col("row")[lang_col].alias("lang"), t.alias("form")))

    def work(texts: pa.Table, found: pa.Table) -> pa.Table:
        row, known = texts.column("row").combine_chunks(), found.column("_pair").combine_chunks()
        columns = dict(zip(carried, row.flatten()))
        tokens, at = columns[tokens_col], columns[lang_col]
        parent, form = pc.list_parent_indices(tokens), tokens.flatten()
        there = form.is_valid()
        parent, form = parent.filter(there), form.filter(there)
        name = lambda a, b: pc.binary_join_element_wise(a, b, "\x00")
        place = pc.index_in(name(at.take(parent), form), value_set=name(known.field("lang"), known.field("form")), skip_nulls=True)
        lemma = pc.coalesce(found.column("lemma").combine_chunks().take(place), form)
        ends = np.bincount(parent.to_numpy(), minlength=len(row)).cumsum()
        lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), lemma)
        columns[out_col] = pc.binary_join(lists, " ")
        return pa.table({f.name: columns[f.name] for f in schema})

    return meet(rows.drop("uid"), pairs, d, "_pair", "inner", work, schema, arrow=True)
