"""Readers: export resolution, union with ordinals, lexicon, stage choice."""

import os
import tempfile

import pytest

from textpulse.sources import readers as R


def test_resolve_and_read_exports(spark):
    d = tempfile.mkdtemp(prefix="tp-src-")
    a = spark.createDataFrame([(1, "college", "x")], "post_id long, forum string, text string")
    b = spark.createDataFrame([(2, "etudiants")], "post_id long, forum string")
    a.write.parquet(os.path.join(d, "posts_of_college_new.parquet"))
    b.write.parquet(os.path.join(d, "02_posts_of_etudiants_new.parquet"))
    assert R.resolve_export(d, "posts_of_etudiants_new", "parquet").endswith("02_posts_of_etudiants_new.parquet")
    assert R.resolve_export(d, "posts_of_Student_new", "parquet") is None
    for where in (d, f"file://{d}"):  # a path, and a URI that only Spark's file systems read
        df = R.read_exports(spark, where)
        rows = sorted((r["post_id"], r["file_rank"], r["text"]) for r in df.collect())
        assert rows == [(1, 0, "x"), (2, 3, None)]
    with pytest.raises(FileNotFoundError):
        R.read_exports(spark, os.path.join(d, "nothing"))


def test_export_names():
    assert R.DEFAULT_EXPORTS == ["posts_of_college_new", "posts_of_collegerant_new", "posts_of_csMajors_new",
                                 "posts_of_etudiants_new", "posts_of_Student_new", "posts_of_Students_new"]


def test_rows_keep_the_order_of_their_files(spark):
    """However files are split: by path, then by row."""
    from textpulse.operators.dedup import keep_first
    d = tempfile.mkdtemp(prefix="tp-ord-")
    p = os.path.join(d, "posts_of_college_new.parquet")
    spark.createDataFrame([(i % 50, f"t{i}") for i in range(400)], "post_id long, text string").repartitionByRange(4, "text").write.parquet(p)
    want = {}
    for r in sorted(spark.read.parquet(p).select("post_id", "text", "_metadata.file_path", "_metadata.row_index").collect(), key=lambda r: (r[2], r[3])):
        want.setdefault(r[0], r[1])
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = keep_first(R.read_exports(spark, d), "post_id", ["file_rank", "row_pos"])
        assert {r["post_id"]: r["text"] for r in got.collect()} == want
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_typed_csv(spark):
    d = tempfile.mkdtemp(prefix="tp-csv-")
    with open(os.path.join(d, "a.csv"), "w", encoding="utf-8-sig") as f:
        f.write('post_id,score,text\n1,0.5,"a ""q"" b"\n2,,c\n')
    df = R.read_table(spark, d, "csv")
    assert df.dtypes == [("post_id", "int"), ("score", "double"), ("text", "string")]
    assert [tuple(r) for r in df.collect()] == [(1, 0.5, 'a "q" b'), (2, None, "c")]


def test_read_lexicon_and_pick_stage(spark):
    d = tempfile.mkdtemp(prefix="tp-lex-")
    p = os.path.join(d, "lex.txt")
    with open(p, "w") as f:
        f.write("Fear\tfear\t1\nhappy\tjoy\t0\n")
    lex = R.read_lexicon(spark, p).collect()
    assert [(r["word"], r["emotion"], r["association"]) for r in lex] == [("Fear", "fear", 1), ("happy", "joy", 0)]
    spark.createDataFrame([(1,)], "a int").write.parquet(os.path.join(d, "clean"))
    got = R.pick_stage(spark, [os.path.join(d, "topics"), os.path.join(d, "clean")])
    assert got is not None and got.columns == ["a"]


def test_unreadable_stage_files_are_passed_over(spark, tmp_path):
    """No file, a file that is no Parquet, an empty folder: the next one is taken."""
    from textpulse.sources import readers as R
    good = spark.createDataFrame([(1, "a")], "post_id int, text string")
    good.write.parquet(str(tmp_path / "clean"))
    (tmp_path / "garbage.parquet").write_bytes(b"this is no parquet file at all" * 20)
    (tmp_path / "empty").mkdir()
    paths = [str(tmp_path / x) for x in ("missing", "garbage.parquet", "empty", "clean")]
    assert [tuple(r) for r in R.pick_stage(spark, paths).collect()] == [(1, "a")]
    assert R.pick_stage(spark, paths[:3]) is None


def test_clean_export_has_the_known_columns(spark, tmp_path):
    from textpulse.operators.cleaning import CLEAN_COLUMNS
    from textpulse.sources import sinks as SK
    df = spark.createDataFrame([(1, "en", "x", 3, "kept not"), (2, "fr", "y", 4, "kept not"), (None, None, "z", 0, "")],
                               "n_tokens int, lang string, text_clean string, post_id int, scratch string")
    known = [c for c in CLEAN_COLUMNS if c in df.columns]
    assert SK.project_known(df).columns == known and "scratch" not in known
    SK.export_clean(df, str(tmp_path / "p"), partition_by=["lang"])
    back = spark.read.parquet(str(tmp_path / "p"))
    assert set(back.columns) == set(known) and back.count() == 3
    assert (tmp_path / "p" / "lang=en").is_dir()
    plan = back.where("lang = 'fr'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan and back.where("lang = 'fr'").count() == 1
    SK.export_clean(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == known


def test_counters_are_observed_without_a_job(spark):
    from textpulse.operators import quality as QU
    df = spark.createDataFrame([(True, False, "", 0), (False, True, "a b", 2), (False, False, "c", 4)],
                               "lang_conflict boolean, is_too_short boolean, text_clean string, n_tokens int")
    own = spark.newSession()
    seen, counters = QU.observe_counters(own.createDataFrame(df.collect(), df.schema))
    assert seen.count() == 3
    assert counters.get == {"conflicts": 1.0, "too_short": 1.0, "empty_after_fallback": 1.0, "zero_token_posts": 1.0, "mean_tokens": 2.0}


def test_scores_attach_to_every_row(spark):
    from textpulse.operators.scoring import attach
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "post_id int, t string")
    raw = spark.createDataFrame([(1, [("x", 0.5)]), (None, [("x", 0.25)])], "post_id int, raw_scores array<struct<label: string, score: double>>")
    got = {r["post_id"]: r["s"] and r["s"][0]["score"] for r in attach(df, raw, "post_id", "s").collect()}
    assert got == {1: 0.5, None: 0.25, 3: None}
