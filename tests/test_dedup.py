"""Keep-first de-duplication against brute force, in both forms."""

import random

import pytest
from pyspark.sql import functions as F

from textpulse.operators.dedup import keep_first

SCHEMA = "post_id long, text string, file_rank int, row_pos long, _key string, _place int, _first int, _n int"


def _rows(seed, n=600):
    rng = random.Random(seed)
    out = []
    for pos in range(n):
        key = rng.choice([None, 7, rng.randrange(n)]) if rng.random() < 0.6 else rng.randrange(n)  # null and one hot id
        out.append((key, f"text {pos}" if rng.random() < 0.9 else None, rng.randrange(3), pos if rng.random() < 0.95 else pos - (1 << 62), "k", 1, 2, 3))
    return out


def _want(rows):
    best = {}
    for r in rows:
        if r[0] not in best or (r[2], r[3]) < (best[r[0]][2], best[r[0]][3]):
            best[r[0]] = r
    return sorted(best.values(), key=str)


@pytest.mark.parametrize("unique", [False, True])
def test_first_row_of_each_key(spark, unique):
    rows = _rows(1)
    for parts in (1, 7):
        got = keep_first(spark.createDataFrame(rows, SCHEMA).repartition(parts), "post_id", ["file_rank", "row_pos"], unique)
        assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert sorted(map(tuple, got.collect()), key=str) == _want(rows)


def test_orders_of_other_types(spark):
    """A struct (file and row number), a single number, nulls first, far numbers."""
    rows = [(1, "b", 5, -(1 << 63)), (1, "a", 9, (1 << 63) - 1), (2, None, None, 4), (2, "x", 3, 5), (None, "n", 1, 1), (None, "m", 0, 2)]
    df = spark.createDataFrame(rows, "id int, file string, n int, pos long")
    d = df.withColumn("place", F.struct("file", "n"))
    pick = lambda out, c: sorted((str(r["id"]), r[c]) for r in out.collect())
    assert pick(keep_first(d, "id", ["place"], True), "file") == [("1", "a"), ("2", None), ("None", "m")]
    assert pick(keep_first(df, "id", ["pos"], True), "pos") == [("1", -(1 << 63)), ("2", 4), ("None", 1)]
    assert pick(keep_first(df, "id", ["n", "pos"], True), "pos") == [("1", -(1 << 63)), ("2", 4), ("None", 2)]
    assert keep_first(df.limit(0), "id", ["pos"], True).count() == 0


def test_rows_that_tie_leave_one(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (2, "b", 0)], "id int, t string, n int")
    assert sorted(map(tuple, keep_first(df, "id", ["n"]).collect())) == [(1, "a", 0), (2, "b", 0)]


def test_no_wide_column_is_aggregated_or_moved(spark, tmp_path):
    """Over files the de-duplication reads ids and places alone; few repeated
    keys are broadcast at run time, so texts are not shuffled."""
    path = str(tmp_path / "posts")
    spark.createDataFrame(_rows(2), SCHEMA).repartition(6).write.parquet(path)
    out = keep_first(spark.read.parquet(path), "post_id", ["file_rank", "row_pos"], True)
    assert sorted(map(tuple, out.collect()), key=str) == _want(_rows(2))
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "SortAggregate" not in plan and "ReadSchema: struct<post_id:bigint,file_rank:int,row_pos:bigint>" in plan
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final


def test_clean_posts_picks_the_form_by_what_can_be_read_again(spark, tmp_path):
    from textpulse.operators import cleaning
    from textpulse.sources.readers import read_exports
    rows = [(1, "etudiants", "t", "body one"), (1, "etudiants", "t", "later"), (2, "college", None, "body two")]
    df = spark.createDataFrame(rows, "post_id int, forum string, title string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "college.parquet"))
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "college.csv"))
    for fmt, repeatable in (("parquet", True), ("csv", False)):
        posts = read_exports(spark, str(tmp_path), ["college"], fmt).withColumn("lang_detected", F.lit("en"))
        assert cleaning._repeatable(posts) is repeatable
        got = sorted((int(r["post_id"]), r["text"]) for r in cleaning.clean_posts(posts).collect())
        assert got == [(1, "body one"), (2, "body two")]
