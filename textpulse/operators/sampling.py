"""Reproducible exact-size sampling (FLT-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse import constants as K


CELLS = 65536


def sample_n(df: DataFrame, n: int | None, key: str = "post_id", seed: int = K.SAMPLE_SEED) -> DataFrame:
    """Exactly ``n`` rows without replacement; 0 / None = all rows; more than
    there are is an error.

    Rows are ranked by a seeded hash of the key (ties by the key), so the
    sample depends neither on partitioning nor on input order. A histogram of
    the hash (``CELLS`` counts) shows the cell in which the n-th row lies: rows
    of the cells before are taken where they are, and only that one cell is
    sorted. The limit is the operator itself (a sampler), not a cap on work.
    """
    if not n:
        return df
    h = F.xxhash64(F.col(key), F.lit(seed))
    cell = F.shiftright(h, 48) + CELLS // 2  # the leading 16 bits, in order
    counts = sorted(df.groupBy(cell.alias("cell")).count().collect())
    before = 0
    for c, rows in counts:
        if before + rows >= n:
            whole = df.filter(cell < c)
            rest = df.filter(cell == c).orderBy(h, F.col(key)).limit(int(n) - before)
            return whole.unionByName(rest)
        before += rows
    raise ValueError(f"a sample of {n} from {before} rows")
