"""Every registered query with an SQL twin agrees with DuckDB at sf0.001;
rows-only queries run and return rows."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_queries_match_duckdb(spark):
    import duckdb

    from textpulse.plans.registry import oracle_sql, queries
    from tools.oracle_check import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    sqls = oracle_sql()
    for name, fn in queries().items():
        sdf = fn(spark, SF)
        srecs = [tuple(r) for r in sdf.collect()]
        if name not in sqls:
            assert len(srecs) > 0, name
            continue
        res = con.execute(sqls[name])
        dcols = [d[0] for d in res.description]
        assert sorted(sdf.columns) == sorted(dcols), name
        assert rows_of(sdf.columns, srecs) == rows_of(dcols, res.fetchall()), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_invariants_of_the_trained_queries(spark):
    """What must hold whatever a model learns."""
    from textpulse.plans.registry import queries
    q = queries()
    posts = {r.post_id: r for r in q["topics_of_posts"](spark, SF).collect()}
    wanted = {r.post_id for r in q["en_fr_min_tokens"](spark, SF).collect()}
    assert set(posts) == wanted  # every post of the topic input, once
    ids = {r.topic_id for r in posts.values()}
    assert -1 in ids and max(ids) >= 0 and all(0 <= r.topic_prob <= 1 for r in posts.values())
    assert all((r.topic_label == "outlier") == (r.topic_id == -1) for r in posts.values())
    found = q["topics_found"](spark, SF).collect()
    assert {r.topic_id for r in found} == ids - {-1}
    assert all(r["count"] == r.n_posts and r.assigned + r.outliers == len(wanted) for r in found)
    merged = q["topic_merge"](spark, SF).collect()
    assert len({r.topic_id for r in merged}) == 4
    lda = q["lda_topics"](spark, SF).collect()
    assert {r.post_id for r in lda} == wanted and all(0 <= r.topic_id < 12 for r in lda)
    clean = {r.post_id: r for r in q["clean_stage"](spark, SF).collect()}
    full = {r.post_id: r for r in q["clean_stage_detected"](spark, SF).collect()}
    assert set(full) == set(clean) and {r.lang_detected for r in full.values()} <= {"en", "fr", "other", "unknown"}
    same = sum(full[k].lang_detected == clean[k].lang_detected for k in clean)
    assert same > 0.9 * len(clean) and all(full[k].text_clean == clean[k].text_clean for k in clean)
    assert any(full[k].text_lemma != clean[k].text_lemma for k in clean)
    enriched = q["enrich_with_models"](spark, SF).collect()
    assert len(enriched) == len(clean) and {r.sentiment_label for r in enriched} <= {"positive", "neutral", "negative"}
