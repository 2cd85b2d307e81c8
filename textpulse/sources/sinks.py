"""Sinks (SNK-1..5) and stage materialisation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse.operators.cleaning import CLEAN_COLUMNS


def project_known(df: DataFrame, columns: list[str] = CLEAN_COLUMNS) -> DataFrame:
    """PRJ-9 / SNK-1: the known output columns that exist, in fixed order."""
    return df.select(*[c for c in columns if c in df.columns])


def csv_ready(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text (the CSV writer rejects them)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """SNK-2 / SNK-3 / SNK-4: write a stage or report table. Parquet by
    default (optionally partitioned, e.g. by ``lang`` for partition pruning);
    CSV gets a header and JSON-encoded nested columns."""
    out = csv_ready(df) if fmt == "csv" else df
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def export_clean(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """SNK-1: project the known clean columns and write them."""
    write_stage(project_known(df), path, fmt, partition_by)


def write_summaries(tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> None:
    """SNK-3: the four aggregate tables (see ``aggregate.all_summaries``)."""
    for name, t in tables.items():
        write_stage(t, f"{out_dir.rstrip('/')}/{name}", fmt)


_WRITTEN: dict[str, list[str]] = {}


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's checkpoint folder."""
    from textpulse.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables that this application has written so far
    and say how many there were. Frames that read them can't be used any more:
    call it between jobs of a long-lived session."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def materialize(spark: SparkSession, df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the cluster's checkpoint folder
    (``spark.checkpoint.dir``) and read it back: a reliable copy that cuts
    the lineage and survives executor loss, so several downstream queries
    can share one computation of an expensive stage."""
    path = fresh_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
