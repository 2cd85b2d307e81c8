"""The pipeline, stage by stage, against brute force; and its registration."""

from collections import defaultdict

import pytest

import corpus_pipeline
from textpulse.llm import mixing, packing, queries
from textpulse.llm.common import fresh_path
from test_near_quality import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and what each stage wrote, as the driver runs them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    out.append(docs)
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = fresh_path(spark, f"test-{name}")
        f(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_only_rejects(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    predicted = {r.doc_id: r.predicted for r in queries.op4_quality(spark, SF).collect()}
    assert after == {d: r for d, r in before.items() if predicted[d] == 1}
    assert 0.8 * len(before) < len(after) < len(before)


def test_exact(stages):
    before, after = rows(stages[1]), rows(stages[2])
    largest = {}
    for d, r in before.items():
        largest[r.text] = max(d, largest.get(r.text, d))
    assert after == {d: before[d] for d in largest.values()}


def test_near(stages):
    before, after = rows(stages[2]), rows(stages[3])
    want = {c for _, n, c in brute([(d, r.text) for d, r in before.items()], 5)}
    assert after == {d: before[d] for d in want}


def test_mix_keeps_all_and_orders(spark, stages):
    before, after = stages[3], stages[4]
    assert rows(before) == rows(after)
    order = [r.doc_id for r in after.collect()]  # files are read in order of their names
    want = mixing.mix(before, corpus_pipeline.TARGETS).orderBy("mix_slot", "mix_place").collect()
    assert order == [r.doc_id for r in want]
    first = [r.source for r in want[: 8 * 20]]
    assert first.count("src0") == pytest.approx(0.25 * len(first), abs=16)


def test_pack(stages):
    docs, got = rows(stages[4]), stages[5].collect()
    tok = packing._tokenizer(packing.default_tokenizer())
    lengths, fill = defaultdict(int), defaultdict(int)
    for r in got:
        lengths[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert lengths == {d: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in docs.items()}
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_sequences_follow_the_mix(spark, docs):
    """A hot source with most documents: the first sequences have the mix's
    shares, not the table's, until the others run out."""
    rows = [(i, f"text number {i} of some words", "src0" if i % 10 else f"src{i // 10 % 4 + 1}") for i in range(4000)]
    table = docs(rows).select("doc_id", "text", "lang", "source", "n_chars").repartition(5)
    mixed = corpus_pipeline.mix_sources(spark, table, SF)
    got = corpus_pipeline.pack_sequences(spark, mixed, SF).collect()
    of = {i: s for i, _, s in rows}
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))]
    assert sorted(order) == sorted(of)
    mix = [r.doc_id for r in mixing.mix(table, corpus_pipeline.TARGETS).orderBy("mix_slot", "mix_place").collect()]
    for stretch in (slice(0, 500), slice(1000, 2000)):
        want = [of[d] for d in mix[stretch]].count("src0") / len(mix[stretch])
        assert [of[d] for d in order[stretch]].count("src0") / len(order[stretch]) == pytest.approx(want, abs=0.2)


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert set(queries.oracle_sql()) <= set(names)
