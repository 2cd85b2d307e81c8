"""Exact de-duplication by skew-safe combining (DataFrame functions only).

Copies are combined in three steps, each of which compares whole contents
because the content itself is a grouping key:

1. locally: Spark's partial aggregate leaves one row per content and task;
2. by salt: those rows meet by (digest, salt, content), so a content that
   holds a third of all rows is spread over ``salts`` tasks;
3. globally: the salt winners, at most ``salts`` a content, meet by digest.

Defined results: null text equals the empty text; a null id is smaller than
any id; rows with the same id and the same text are each returned, and one of
them is kept (``copies`` counts them); an empty table gives an empty table;
extra columns of any name are kept by ``deduplicate`` and ignored by
``decisions``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpulse.llm.common import join_hot, materialize

SALTS = 64


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content.cast("binary"), 256))


def _winners(keyed: DataFrame, salts: int) -> DataFrame:
    """(_digest, _content, keep_id, group_size) from (_digest, _content, _id)."""
    local = (keyed.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
             .groupBy("_digest", "_salt", "_content")
             .agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n")))
    # Dealt by digest alone, so that the contents of one digest can be counted
    # without another shuffle.
    return (local.repartition("_digest").groupBy("_digest", "_content")
            .agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size")))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, copies, kept, text_sha256.

    Rows find their group by digest. That is exact because step 3 has counted
    the different contents of every digest; if any digest holds two contents,
    rows are joined on the whole content instead.
    """
    content = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_id"), content.alias("_content")).withColumn("_digest", digest(F.col("_content")))
    won = _winners(keyed, salts)
    of_digest = Window.partitionBy("_digest")
    narrow = won.select("_digest", "keep_id", "group_size", F.count(F.lit(1)).over(of_digest).alias("_contents"))
    groups = materialize(narrow, "exact-groups")
    count = F.count(F.lit(1)).alias("copies")
    if groups.filter("_contents > 1").isEmpty():
        if digest is sha256:
            rows = keyed.groupBy("_id", "_digest").agg(count).withColumn("text_sha256", F.lower(F.hex("_digest")))
        else:
            rows = keyed.groupBy("_id", "_digest").agg(count, F.min(F.sha2("_content", 256)).alias("text_sha256"))
        # A text that a third of all rows have is joined without gathering them.
        out = join_hot(materialize(rows, "exact-rows"), groups.withColumn("_rows", F.col("group_size")), "_digest", "_rows")
    else:
        rows = keyed.groupBy("_id", "_digest", "_content").agg(count)
        out = rows.join(won, ["_digest", "_content"]).withColumn("text_sha256", F.sha2("_content", 256))
    each = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(F.col("_id").alias(id_col), "keep_id", "group_size", "copies",
                       (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with
    the largest id (of rows with that id too, any one). The rest of each row
    travels beside its content, so no join back is needed."""
    names = [c for c in docs.columns if c != text_col]
    d = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text, ident = F.col(at[text_col]), F.col(at[id_col])
    keyed = d.select(sha256(F.coalesce(text.cast("string"), F.lit(""))).alias("_digest"),
                     F.coalesce(text.cast("string"), F.lit("")).alias("_content"),
                     F.struct(ident.isNotNull(), ident, text.isNotNull()).alias("_rank"),
                     F.struct(text.isNull().alias("_null"), *[at[c] for c in names]).alias("_row"),
                     F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"))
    best = lambda: (F.max_by("_row", "_rank").alias("_row"), F.max("_rank").alias("_rank"))
    local = keyed.groupBy("_digest", "_salt", "_content").agg(*best())
    won = local.groupBy("_digest", "_content").agg(*best())
    return won.select(*[(F.when(~F.col("_row._null"), F.col("_content")) if c == text_col
                         else F.col(f"_row.{at[c]}")).alias(c) for c in docs.columns])
