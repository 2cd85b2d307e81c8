"""Exact de-duplication and mixing against brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textpulse.llm import exact, mixing


def brute(rows):
    best, size = {}, Counter()
    for i, t, _ in rows:
        t = t or ""
        size[t] += 1
        best[t] = max((x for x in (best.get(t), i) if x is not None), default=None)
    return {(i, best[t or ""], size[t or ""], i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows}


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.crc32(c.cast("binary")) % 2], ids=["sha256", "colliding"])
def test_decisions(messy, digest):
    """A digest under which different texts collide gives the same groups."""
    rows = [(r.doc_id, r.text, r.source) for r in messy.collect()]
    got = exact.decisions(messy, salts=3, digest=digest).collect()
    want, once = brute(rows), set()
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == {(a, b, c, e) for a, b, c, _, e in want}
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    for r in got:  # of rows that repeat, one stays
        assert not r.kept or (r.keep_id == r.doc_id and r.text_sha256 not in once)
        once |= {r.text_sha256} if r.kept else set()
    assert len(once) == len({e for *_, e in want})


def test_deduplicate_keeps_rows_whole(messy):
    got = exact.deduplicate(messy, salts=2)
    assert got.columns == messy.columns and got.dtypes == messy.dtypes
    rows = got.collect()
    assert sorted((r.doc_id, (r.text or "")[:5], r._uid, r._digest) for r in rows) == [
        (2, "", 1, "d"), (4, "one", 1, "d"), (6, "w0é w", 1, "d"), (7, "x\ty\n ", 1, "d"), (8, "퟿ 🙂 漢", 1, "d")]
    assert next(r for r in rows if r.doc_id == 2).text == ""  # null and empty are equal; the larger id's own value stays


def test_empty_tables(docs):
    none = docs([])
    assert exact.decisions(none).count() == 0 and exact.deduplicate(none).count() == 0
    assert mixing.mix(none, {"a": 0.5}).count() == 0 and mixing.interleave(none, {}).count() == 0


def test_hot_group(docs):
    d = docs([(i, "same" if i % 3 else f"t{i}", "s") for i in range(300)]).repartition(7)
    got = {r.doc_id: r for r in exact.decisions(d, salts=4).collect()}
    assert got[1].group_size == 200 and got[1].keep_id == 299 and sum(r.kept for r in got.values()) == 101


@pytest.mark.parametrize("weights", [{}, {"a": 0.6}, {"a": 0.5, "b": 0.3, "c": 0.2}])
def test_less_than_a_block_from_target(docs, weights):
    counts = {"a": 90, "b": 40, "c": 13, None: 7}
    rows = [(1000 * k + i, "t", s) for k, (s, n) in enumerate(counts.items()) for i in range(n)]
    block = 2
    got = mixing.mix(docs(rows), weights, block_docs=block, bucket_docs=9).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
    slots = {}
    for r in got:
        assert r.mix_release <= r.mix_slot < r.mix_due
        assert slots.setdefault(r.mix_slot, (r.source, r.mix_block)) == (r.source, r.mix_block)
    assert sorted(slots) == list(range(len(slots)))
    assert len({(r.source, r.mix_block, r.mix_place) for r in got}) == len(got)
    # The blocks of a source come in order, and after each slot each source is
    # less than one block from the ideal schedule.
    left = 1 - sum(weights.values())
    names = sorted((s for s in counts if s is not None)) + [None]
    free = [s for s in names if s not in weights]
    p = {s: weights.get(s, max(left, 1 / 256) / len(free) if free else 0) for s in names}  # targets, not rounded
    m = {s: -(-counts[s] // block) for s in names}
    had = defaultdict(int)
    for t in range(len(slots)):
        s, b = slots[t]
        assert b == had[s]
        had[s] += 1
        low, high = 0.0, max(m[x] / p[x] for x in names)  # cycles that the ideal schedule has gone through
        for _ in range(80):
            v = (low + high) / 2
            low, high = (v, high) if sum(min(m[x], p[x] * v) for x in names) < t + 1 else (low, v)
        for x in names:
            assert abs(had[x] - min(m[x], p[x] * high)) < 1 + 1e-9


def test_interleave(messy):
    got = mixing.interleave(messy, {"a": 0.5}, block_docs=1)
    assert got.columns == messy.columns
    order = [r.source for r in got.collect()]
    assert len(order) == 11 and Counter(order) == {"a": 6, "b": 2, "c": 2, None: 1}
    assert order[:6].count("a") == 3


@pytest.mark.parametrize("sources, weights", [(20, {"s0": 0.25}), (120, {"s0": 0.25, "s1": 0.1}), (400, {"s0": 0.25}), (7, {"s0": 0.3, "s3": 0.125})])
def test_on_target_over_many_cycles(spark, sources, weights):
    """Thousands of slots; until a source runs out each is less than one block
    from its target as it was given."""
    each = 8 if sources > 100 else 130
    counts = {f"s{i}": each for i in range(sources)} | {k: int(1.2 * each * sources * v) for k, v in weights.items()}
    rows = [(1000_000 * k + i, s) for k, (s, n) in enumerate(counts.items()) for i in range(n)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_docs=1)
    order = [r.source for r in got.orderBy("mix_slot").collect()]
    assert len(order) == len(rows)
    left = (1 - sum(weights.values())) / (sources - len(weights))
    had, t = Counter(), 0
    for t, s in enumerate(order, 1):
        had[s] += 1
        if t % 7 == 0 or t < 100:
            assert all(abs(had[x] - weights.get(x, left) * t) < 1 + 1e-9 for x in counts), t
        if had[s] == counts[s]:
            break
    assert t > len(rows) / 3


def test_parts_add_up():
    for share in (["0.25", *["0.0394736842105"] * 19], ["0.123457", "0.876543"], ["0.999999", "0.000001"], ["1"]):
        parts = mixing.whole_parts([mixing.Fraction(x) / sum(map(mixing.Fraction, share)) for x in share], 64)
        assert min(parts) >= 1 and sum(parts) <= max(64, 4 * len(share)) + len(share)
    assert mixing.whole_parts(mixing.targets(["sa", "sb", "sc", "z"], {"a": 0.25})) == [1, 1, 1, 1]
    assert mixing.whole_parts(mixing.targets(["sa", *[f"s{i}" for i in range(19)]], {"a": 0.25})) == [19, *[3] * 19]
    with pytest.raises(ValueError, match="above 0"):
        mixing.targets(["sa"], {"a": 0.0})


def test_too_many_sources(docs, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError, match="more than 2 sources"):
        mixing.mix(docs([(1, "t", "a"), (2, "t", "b"), (3, "t", "c")]), {})


def test_native_plans(messy):
    for d in (exact.decisions(messy), exact.deduplicate(messy), mixing.mix(messy, {})):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Cross" not in plan
