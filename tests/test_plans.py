"""Plan shapes. The clean stage: column pruning at the scan, ids and places
alone in the de-duplication, one Python step (NFC). Queries that need scores
alone: no text column is read. The flagship: a narrow written table, no
Python, no nested loop, the text steps are not run again."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def formatted(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_clean_stage_plan(spark):
    from textpulse.plans.registry import queries
    plan = formatted(spark, queries()["clean_stage"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan
    assert "ReadSchema: struct<doc_id:bigint>" in plan  # the de-duplication's own scan
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "Window" not in plan
    assert plan.count("ArrowEvalPython (") == 1   # NFC only
    assert "BatchEvalPython" not in plan          # no row-at-a-time Python UDF


@pytest.mark.parametrize("name", ["weekday_patterns", "mean_by_lang_pivot", "sentiment_label_counts", "sentiment_fold"])
def test_scores_alone_run_no_text_step(spark, name):
    """No clean chain, no lexicon, and nothing of the clean table is written."""
    from textpulse.plans.registry import queries
    plan = formatted(spark, queries()[name](spark, SF))
    assert "EvalPython" not in plan and "/clean-" not in plan and "Generate explode(tokens" not in plan
    assert plan.count("regexp_replace") == 0


def test_written_clean_table_is_narrow(spark, monkeypatch):
    """What the summaries write of the clean table, and that they do so once."""
    from textpulse.plans import stages
    from textpulse.plans.registry import queries
    written = []
    keep = stages.materialize
    monkeypatch.setattr(stages, "materialize", lambda spark, df, name: written.append(df.columns) or keep(spark, df, name))
    for name in ("agg_month", "enrich_stage", "emotion_heatmap"):
        queries()[name](spark, SF)
    assert written == [[*stages.NARROW, "tokens"]] * 3
    queries()["top_distress"](spark, SF)
    assert written[3:] == [[*stages.NARROW, "tokens", "text_clean"]]


def test_flagship_plan_shape(spark):
    from textpulse.plans.registry import queries
    plan = formatted(spark, queries()["agg_season"](spark, SF))
    assert "EvalPython" not in plan and "regexp_replace" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("HashAggregate") >= 2       # combined in each task first


@pytest.mark.parametrize("name", ["ngram_df_filter", "ctfidf_top_words", "topic_report", "histogram_tokens", "boxplot_lang"])
def test_no_nested_loops_and_one_clean_chain(spark, name):
    from textpulse.plans.registry import queries
    plan = formatted(spark, queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "EvalPython" not in plan               # the clean chain has run, once
