"""Mixing sources to target weights by Pfair scheduling (DataFrame only).

Every source is cut into blocks of ``block_docs`` documents, in a
pseudo-random order of its documents. Target weights become whole parts p_i of
a cycle: their numerators over a common denominator, so nothing is rounded and
every cycle ends exactly on target (weights whose common denominator is beyond
``CYCLE`` are the exception, see ``whole_parts``). An ideal, divisible schedule would give source i in each cycle p_i
blocks at an even pace; a source that runs out stops there, and the others
share its time in proportion to their weights. Written as t(v), the slots
that the ideal schedule has used when it is a share v through the cycle, block
q of source i is released at floor(t(q / p_i)) and due at ceil(t((q + 1) /
p_i)). In each slot the released block with the earliest deadline goes first
(ties: the smaller source name). So after any number of slots each source is
less than one block from the ideal schedule.

Every document is placed once, none is dropped or repeated. Cycles differ only
where some source runs out, so there are at most 2 * sources + 1 kinds, and
the schedule of a kind is one small aggregate over its slots.

Documents get their place in two levels, with no window over a whole source:
the order within (source, bucket) and the summed sizes of the buckets before.
Buckets are ranges of the order key and hold about ``bucket_docs`` documents.

Defined results: a null source is a source of its own, named last; null ids
and texts are placed like others; rows that repeat are each placed; an empty
table gives an empty table; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpulse.llm.common import materialize

CYCLE = 4096         # most slots of a cycle
MOST_SOURCES = 1024
LEAST_LEFT = Fraction(1, 256)  # what sources without a target share if the targets leave less
BLOCK_DOCS = 8
BUCKET_DOCS = 4096


def order_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def targets(keys: list[str], weights: dict[str, float]) -> list[Fraction]:
    """The exact target of each source that is there ('s' and its name, or 'z'
    for the null source); they add up to one. A weight is taken as it is
    written in decimals. Sources without a weight share what the others leave
    equally, ``LEAST_LEFT`` at least."""
    if any(not v > 0 for v in weights.values()):
        raise ValueError("weights must be above 0")
    named = {f"s{k}": Fraction(str(v)) for k, v in weights.items()}
    free = [k for k in keys if k not in named]
    left = max(Fraction(1) - sum(named.values()), LEAST_LEFT) / len(free) if free else Fraction(0)
    share = [named.get(k, left) for k in keys]
    return [x / sum(share) for x in share]


def whole_parts(share: list[Fraction], cycle: int = CYCLE) -> list[int]:
    """Parts of a cycle: the numerators over the common denominator. If that is
    over ``cycle`` (and over four slots a source), whole parts of so many slots,
    one at least, by largest remainder; they add up, but the mix then moves
    away from the targets by less than a block each cycle."""
    slots = math.lcm(*[x.denominator for x in share]) if share else 1
    most = max(cycle, 4 * len(share))
    if slots <= most:
        return [int(x * slots) for x in share]
    parts = [max(1, math.floor(x * most)) for x in share]
    by_remainder = sorted(range(len(share)), key=lambda i: parts[i] - share[i] * most)
    for i in by_remainder[: max(0, most - sum(parts))]:
        parts[i] += 1
    return parts


def with_parts(spark: SparkSession, counts: dict[str, int], weights: dict[str, float], cycle: int, block_docs: int) -> DataFrame:
    """One row per source: key, index, documents, blocks, parts of a cycle."""
    keys = sorted(counts)
    rows = [(k, i, counts[k], -(-counts[k] // block_docs), p) for i, (k, p) in enumerate(zip(keys, whole_parts(targets(keys, weights), cycle)))]
    return spark.createDataFrame(rows, "_key string, _i int, _n long, _blocks long, _parts long")


def schedule(sources: DataFrame) -> DataFrame:
    """(_kind, _from, _i, _q, _slot, _len, _release, _due): the slot in its cycle of each
    block, for each kind of cycle; ``_from`` is the kind's first cycle."""
    s = sources.withColumn("_full", F.floor(F.col("_blocks") / F.col("_parts")).cast("long"))
    starts = s.select(F.explode(F.array(F.lit(0).cast("long"), F.col("_full"), F.col("_full") + 1)).alias("_from")).distinct()
    gathered = s.agg(F.sort_array(F.collect_list(F.struct("_i", "_blocks", "_parts"))).alias("_all"))
    kinds = (starts.withColumn("_all", gathered.scalar())
             .withColumn("_a", F.transform("_all", lambda x: F.greatest(F.lit(0), F.least(x["_parts"], x["_blocks"] - x["_parts"] * F.col("_from"))).cast("long")))
             .withColumn("_len", F.aggregate("_a", F.lit(0).cast("long"), lambda t, x: t + x))
             .filter("_len > 0"))
    # Windows of each source's blocks. Shares of the cycle are fractions of p_i,
    # so sums of whole numbers over p_i are exact.
    used = lambda q, p: F.aggregate("_both", F.lit(0).cast("long"), lambda t, x: t + F.least(x["a"] * p, x["p"] * q))
    window = lambda q, p: F.struct(F.floor(used(q, p) / p).cast("long").alias("release"), F.ceil(used(q + 1, p) / p).cast("long").alias("due"))
    kinds = (kinds.withColumn("_both", F.zip_with("_a", "_all", lambda a, x: F.struct(a.alias("a"), x["_parts"].alias("p"))))
             .withColumn("_windows", F.transform("_both", lambda x: F.when(x["a"] > 0, F.transform(F.sequence(F.lit(0).cast("long"), x["a"] - 1), lambda q: window(q, x["p"]))))))
    # Written: else the optimizer copies the windows into every step below. Kinds
    # are dealt to tasks by number, as their rows are few but their work isn't.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = materialize(kinds.select("_from", "_len", "_a", "_windows").repartition(tasks, "_from"), "mix-kinds")

    # State: blocks that each source has had, and the source of each slot so far.
    def step(state: Column, slot: Column) -> Column:
        waiting = F.zip_with(state["had"], "_windows", lambda q, w: F.when(q < F.size(w), F.get(w, q.cast("int"))))
        ready = F.transform(waiting, lambda w, i: F.when(w["release"] <= slot, F.struct(w["due"].alias("due"), i.cast("int").alias("i"))))
        return F.struct(state["had"].alias("had"), state["order"].alias("order"), F.array_min(ready)["i"].alias("pick"))

    def take(state: Column) -> Column:
        return F.struct(F.transform(state["had"], lambda q, i: F.when(i == state["pick"], q + 1).otherwise(q)).alias("had"),
                        F.concat(state["order"], F.array(state["pick"])).alias("order"), F.lit(None).cast("int").alias("pick"))

    begin = F.struct(F.transform("_a", lambda x: F.lit(0).cast("long")).alias("had"), F.expr("CAST(array() AS array<int>)").alias("order"), F.lit(None).cast("int").alias("pick"))
    both = F.expr("sequence(CAST(0 AS BIGINT), _len * 2 - 1)")  # pick, then take: the pick is bound once
    run = F.aggregate(both, begin, lambda st, t: F.when(t % 2 == 0, step(st, F.floor(t / 2))).otherwise(take(st)))
    slots = kinds.withColumn("_order", run["order"]).select("_from", "_len", "_windows", F.posexplode("_order").alias("_slot", "_i"))
    q = F.row_number().over(Window.partitionBy("_from", "_i").orderBy("_slot")) - 1
    out = slots.withColumn("_q", q.cast("long"))
    w = F.expr("_windows[_i][CAST(_q AS INT)]")
    return out.select("_from", "_i", "_q", F.col("_slot").cast("long").alias("_slot"), "_len",
                      w["release"].alias("_release"), w["due"].alias("_due"))


def mix(docs: DataFrame, weights: dict[str, float], source_col: str = "source", id_col: str = "doc_id",
        block_docs: int = BLOCK_DOCS, cycle: int = CYCLE, bucket_docs: int = BUCKET_DOCS, seed: int = 1) -> DataFrame:
    """``docs`` with mix_block (the block within its source), mix_slot (the
    slot of that block in the whole mix), mix_release and mix_due (the slots it
    must lie between), mix_place (the place in the block). Sorting by (mix_slot,
    mix_place) gives the mix. A column of such a name in ``docs`` is replaced.

    The number of sources may not exceed ``MOST_SOURCES``: more is an error.
    The broadcast tables have at most a row for each slot of each kind of
    cycle: (2 * sources + 1) * the larger of ``cycle`` and 4 * sources.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_release", "mix_due", "mix_place")
    names = docs.columns
    d = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    source = F.col(at[source_col]).cast("string")
    key = F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), source))  # 'z' > 's...'
    d = d.withColumn("_key", key).withColumn("_order", order_key(at[id_col], seed))
    counts = d.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    sizes = {r["_key"]: r["_n"] for r in counts.limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    buckets = max(1, math.ceil(sum(sizes.values()) / bucket_docs))
    leading = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    d = d.withColumn("_bucket", F.floor(leading * buckets / 4294967296.0).cast("int"))

    per_bucket = d.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    sources = with_parts(docs.sparkSession, sizes, weights, cycle, block_docs)
    plan = materialize(schedule(sources), "mix-schedule")
    kinds = plan.select("_from").distinct().agg(F.sort_array(F.collect_list("_from")).alias("_starts"))
    totals = sources.agg(F.collect_list(F.struct("_blocks", "_parts")).alias("_all"))
    about = sources.select("_key", "_i", "_parts", kinds.scalar().alias("_starts"), totals.scalar().alias("_all"))

    ties = [F.col(c) for c in (at[id_col], at[source_col])]
    within = F.row_number().over(Window.partitionBy("_key", "_bucket").orderBy("_order", *ties)) - 1
    ranked = d.withColumn("_within", within).join(offsets, ["_key", "_bucket"])
    rank = F.col("_before") + F.col("_within")
    placed = (ranked.withColumn("mix_block", F.floor(rank / block_docs).cast("long"))
              .withColumn("mix_place", (rank % block_docs).cast("long"))
              .join(F.broadcast(about), "_key")
              .withColumn("_cycle", F.floor(F.col("mix_block") / F.col("_parts")).cast("long"))
              .withColumn("_q", F.col("mix_block") - F.col("_cycle") * F.col("_parts"))
              .withColumn("_from", F.array_max(F.filter("_starts", lambda x: x <= F.col("_cycle"))))
              .withColumn("_base", F.aggregate("_all", F.lit(0).cast("long"), lambda t, x: t + F.least(x["_blocks"], x["_parts"] * F.col("_cycle"))))
              .join(F.broadcast(plan), ["_from", "_i", "_q"]))
    at_slot = lambda c: (F.col("_base") + F.col(c)).cast("long")
    return placed.select(*[F.col(at[c]).alias(c) for c in names], "mix_block", at_slot("_slot").alias("mix_slot"),
                         at_slot("_release").alias("mix_release"), at_slot("_due").alias("mix_due"), "mix_place")


def interleave(docs: DataFrame, weights: dict[str, float], source_col: str = "source", id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, with their own columns."""
    names = docs.columns
    plain = docs.toDF(*[f"i{k}" for k in range(len(names))])
    mixed = mix(plain, weights, f"i{names.index(source_col)}", f"i{names.index(id_col)}", **how)
    return mixed.orderBy("mix_slot", "mix_place").select(*plain.columns).toDF(*names)
