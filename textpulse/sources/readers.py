"""Readers (SRC-1..5).

Every reader is a lazy ``spark.read`` scan; filters and column selections
applied later are pushed into the Parquet scan by Catalyst.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse import constants as K

DEFAULT_EXPORTS = K.EXPORT_NAMES

LEXICON_SCHEMA = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("emotion", T.StringType()),
    T.StructField("association", T.IntegerType()),
])


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the path itself: any store that
    Spark reads will do."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return bool(fs.exists(p))


def _listdir(spark: SparkSession, d: str) -> list[str]:
    fs, p = _file_system(spark, d)
    if not fs.exists(p):
        return []
    return sorted(x.getPath().getName() for x in fs.listStatus(p))


def resolve_export(input_dir: str, name: str, ext: str, spark: SparkSession | None = None) -> str | None:
    """SRC-2: exact ``name.ext``; else the lexicographically smallest file
    matching ``*name.ext`` (numeric prefixes); else None (caller skips it)."""
    spark = spark or SparkSession.getActiveSession()
    names = _listdir(spark, input_dir)
    hits = [f for f in names if f == f"{name}.{ext}"] or [f for f in names if fnmatch.fnmatchcase(f, f"*{name}.{ext}")]
    return f"{input_dir.rstrip('/')}/{hits[0]}" if hits else None


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """SRC-3: one stage table. CSV has a header and quote escaping (the UTF-8
    BOM is skipped by Spark); columns take the given schema, or else types
    inferred from the data. ``multi_line`` allows line ends inside quotes, at
    the price of one task per file."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return (r.option("header", True).option("multiLine", multi_line).option("inferSchema", schema is None)
                .option("escape", '"').csv(path))
    return r.format(fmt).load(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer parts than there are cores (few files or row groups)
    dealt to all cores; a scan with as many parts is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def file_order(fmt: str) -> Column:
    """A row's place in its files: by path, then by row. It doesn't depend on
    how files are split into tasks."""
    if fmt == "parquet":
        return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame | None:
    """SET-1: bag union by column name; missing columns become null."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def read_exports(spark: SparkSession, input_dir: str, names: list[str] | None = None,
                 fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """SRC-1: read every export that exists and union them by name.

    Adds ``file_rank`` (position in ``names``) and ``row_pos`` (the row's
    place in its files) so keep-first de-duplication is defined. Single
    missing exports are skipped; none at all is an error.
    """
    names = names or DEFAULT_EXPORTS
    frames = []
    for rank, name in enumerate(names):
        path = resolve_export(input_dir, name, fmt, spark)
        if path is None:
            continue
        df = read_table(spark, path, fmt, schema)
        frames.append(df.select("*", F.lit(rank).alias("file_rank"), file_order(fmt).alias("row_pos")))
    out = union_by_name(frames)
    if out is None:
        raise FileNotFoundError(f"no export of {', '.join(names)} in {input_dir}")
    return out


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: tab-separated ``word<TAB>emotion<TAB>association``, no header."""
    return spark.read.schema(LEXICON_SCHEMA).option("sep", "\t").csv(path)


def pick_stage(spark: SparkSession, candidates: list[str], fmt: str = "parquet") -> DataFrame | None:
    """SRC-4: the most enriched stage table that exists and can be read."""
    for path in candidates:
        if not path_exists(spark, path):
            continue
        try:
            df = read_table(spark, path, fmt)
            df.schema  # noqa: B018 - forces the footer read
            return df
        except (AnalysisException, SparkRuntimeException, Py4JJavaError):  # unreadable -> try the next one
            continue
    return None
