"""Texts meet a table's rows in blocks.

A text needs the rows of its own terms in a table of any size (topic weights, word
vectors). Joined term by term, a row would travel once for each text that has the
term. Texts are dealt into blocks instead, and each block gets the rows of its
distinct terms once; a task holds one block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TERMS_A_BLOCK = 1_000_000


def deal(texts: DataFrame, terms: int) -> DataFrame:
    """``texts`` with ``block``, dealt by ``uid``; ``terms`` is how many they hold
    together."""
    n = max(2 * texts.sparkSession.sparkContext.defaultParallelism, terms // TERMS_A_BLOCK + 1)
    return texts.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int"))


def meet(texts: DataFrame, terms: Column | str, table: DataFrame | None, term: str, how: str,
         work: Callable, schema: str | StructType, arrow: bool = False) -> DataFrame:
    """``work`` on each block of ``texts`` (see ``deal``; read twice: pass a written
    table) and the rows of ``table`` that its terms have, or its distinct terms alone."""
    needed = texts.select(F.col("block").alias("_block"), F.explode(terms).alias(term)).distinct()
    if table is not None:
        needed = needed.join(table, term, how)
    both = texts.groupBy("block").cogroup(needed.groupBy("_block"))
    return both.applyInArrow(work, schema) if arrow else both.applyInPandas(work, schema)
