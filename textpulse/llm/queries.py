"""Registered queries of this subpackage: each applies one operator, with its
production parameters, to its whole table. SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textpulse.llm import exact, fingerprint, html, lm, minhash, mixing, packing, quality, resample, runs, secrets, simhash, warc
from textpulse.llm.common import table

#: Target weights: the named source's share, the others share the rest equally.
TARGETS = {"src0": 0.25}


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), TARGETS)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = minhash.near_groups(table(spark, sf_dir, "documents"), words=2)
    return d.select("doc_id", "n_shingles", "component_id", "kept")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = exact.decisions(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.with_tails_repeated(table(spark, sf_dir, "documents"))
    return runs.digests(runs.find_runs(docs))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_features", "weight", "score", "rank")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_language_model, op2_fingerprints, op3_mixing, op4_quality, op5_near_dedup, op6_exact_dedup, op7_warc,
        op8_main_text, op9_packing, op10_secrets, op11_periodic_runs, op12_resampling, op13_simhash, pipeline)}


#: CRC-32 in SQL, by its polynomial: a table of the 256 bytes, and a fold over a list of bytes.
CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END) AS v FROM range(256) r(i)))"""


def crc32(numbers: str) -> str:
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {numbers}), "
            "lambda a, x: xor(a >> 8, crc[1 + (xor(a, x) & 255)])), CAST(4294967295 AS BIGINT))")


SQL = {
    "op3_mixing": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS k FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank FROM d),
n AS (SELECT k, count(*) AS n FROM d GROUP BY k),
o AS (SELECT count(*) AS o, count(*) < (SELECT count(*) FROM n) AS named FROM n WHERE k <> 'ssrc0'),
w AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i, (n + {mixing.BLOCK_DOCS - 1}) // {mixing.BLOCK_DOCS} AS m,
        CASE WHEN o = 0 OR NOT named THEN 1 WHEN k = 'ssrc0' THEN o // gcd(o, 3) ELSE 3 // gcd(o, 3) END AS p FROM n, o),
f AS (SELECT DISTINCT unnest([0, m // p, m // p + 1]) AS f FROM w),
a AS (SELECT f, i, p, greatest(0, least(p, m - p * f)) AS a FROM f, w),
b AS (SELECT f, i, p, a, unnest(range(a)) AS q FROM a),
u AS (SELECT b.f, b.i, b.q, b.p, sum(least(x.a * b.p, x.p * b.q)) AS t0, sum(least(x.a * b.p, x.p * (b.q + 1))) AS t1
      FROM b JOIN a x ON x.f = b.f GROUP BY b.f, b.i, b.q, b.p),
v AS (SELECT f, i, q, CAST(t0 // p AS BIGINT) AS rel, CAST((t1 + p - 1) // p AS BIGINT) AS due FROM u),
l AS (SELECT a.f, a.i, list({{'rel': v.rel, 'due': v.due}} ORDER BY v.q) FILTER (WHERE v.q IS NOT NULL) AS w
      FROM a LEFT JOIN v ON v.f = a.f AND v.i = a.i GROUP BY a.f, a.i),
g AS (SELECT f, list(coalesce(w, []) ORDER BY i) AS w FROM l GROUP BY f),
e AS (SELECT f, 0 AS t, w, CAST(list_sum([len(x) FOR x IN w]) AS BIGINT) AS len, [0 FOR x IN w] AS had, CAST(-1 AS BIGINT) AS pick FROM g
      UNION ALL
      SELECT f, t + 1, w, len, [had[j + 1] + CASE WHEN j = pk THEN 1 ELSE 0 END FOR j IN range(len(w))], pk FROM (
        SELECT *, list_min([w[j + 1][had[j + 1] + 1].due * 10000 + j FOR j IN range(len(w))
                            IF had[j + 1] < len(w[j + 1]) AND w[j + 1][had[j + 1] + 1].rel <= t]) % 10000 AS pk FROM e WHERE t < len)),
s AS (SELECT f, pick AS i, had[pick + 1] - 1 AS q, t - 1 AS slot FROM e WHERE pick >= 0),
c AS (SELECT r.doc_id, r.source, w.i, w.p, r.rank // {mixing.BLOCK_DOCS} AS block, r.rank % {mixing.BLOCK_DOCS} AS place FROM r JOIN w USING (k)),
k AS (SELECT *, block // p AS cycle, block - block // p * p AS q FROM c),
z AS (SELECT cycle, (SELECT max(s.f) FROM s WHERE s.f <= cycle) AS f, (SELECT sum(least(m, p * cycle)) FROM w) AS base FROM (SELECT DISTINCT cycle FROM k))
SELECT k.doc_id, k.source, CAST(k.block AS BIGINT) AS mix_block, CAST(z.base + s.slot AS BIGINT) AS mix_slot,
       CAST(z.base + v.rel AS BIGINT) AS mix_release, CAST(z.base + v.due AS BIGINT) AS mix_due, CAST(k.place AS BIGINT) AS mix_place
FROM k JOIN z USING (cycle) JOIN s ON s.f = z.f AND s.i = k.i AND s.q = k.q JOIN v ON v.f = z.f AND v.i = k.i AND v.q = k.q""",
    "op5_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+') IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])
                                 WHEN len(w) = 1 THEN w ELSE [] END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, c.c AS component_id, n.doc_id = c.c AS kept
FROM n JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) c USING (doc_id)""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op7_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, b,
             list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST((CAST(('0x' || substr(x, (i // 4) * 5 + 1, 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)
               FOR i IN range(0, 32)], 'string_agg', '') AS payload_digest,
             min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op8_main_text": r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS a FROM pages),
b AS (SELECT page_id, url, replace(replace(replace(replace(replace(regexp_replace(a, '<[^>]*>', ' ', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c""",
    "op11_periodic_runs": r"""
WITH """ + CRC_TABLE + r""",
w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+') IF x <> ''] AS w, """ + crc32("[ascii(x) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]") + r""" AS h FROM documents, crc),
a AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS b FROM w),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + b)) END] FOR i IN range(n)] ELSE w END AS w FROM a),
g AS (SELECT doc_id, n, unnest(range(n - 7)) AS i, unnest([array_to_string(w[i + 1 : i + 8], ' ') FOR i IN range(n - 7)]) AS g FROM d WHERE n >= 24),
p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
l AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS l FROM p),
m AS (SELECT doc_id, min(i) AS s, max(i) - min(i) + 8 + q AS n, q FROM l GROUP BY doc_id, q, l HAVING max(i) - min(i) + 8 + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, s, n, min(q) AS q FROM m GROUP BY doc_id, s, n),
o AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM r),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM d) ANTI JOIN o USING (doc_id, i) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS c, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(n AS DOUBLE) / q DESC, s, q) AS place FROM r)
SELECT d.doc_id, CAST(coalesce(t.c, 0) AS BIGINT) AS n_runs, CAST(z.s AS BIGINT) AS start, CAST(z.n AS BIGINT) AS length, CAST(z.q AS BIGINT) AS period,
       CAST(1000 * z.n // z.q AS BIGINT) AS exponent_milli, sha256(coalesce(t.lines, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN z ON z.doc_id = d.doc_id AND z.place = 1""",
    "op12_resampling": r"""
WITH """ + CRC_TABLE + r""",
x AS (SELECT 0 AS b, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
w AS (SELECT b, doc_id, [y FOR y IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF y <> ''] AS w FROM x),
f AS (SELECT b, doc_id, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS f FROM w),
u AS (SELECT f, b, doc_id, count(*) AS c FROM f GROUP BY ALL),
e AS (SELECT f, hex(encode(f)) AS e FROM (SELECT DISTINCT f FROM u)),
k AS (SELECT f, """ + crc32("[CAST('0x' || substr(e, 2 * i + 1, 2) AS BIGINT) FOR i IN range(len(e) // 2)]") + r""" % 10000 AS k FROM e, crc),
n AS (SELECT k, coalesce(sum(c) FILTER (WHERE b = 0), 0) AS s, coalesce(sum(c) FILTER (WHERE b = 1), 0) AS t FROM u JOIN k USING (f) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000.0::DOUBLE)))) AS g FROM n),
v AS (SELECT doc_id, sum(c) AS n, floor(CAST(sum(c * g) AS DOUBLE) / sum(c)) AS v FROM u JOIN k USING (f) JOIN g USING (k) WHERE b = 0 GROUP BY doc_id),
s AS (SELECT doc_id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(v, 0) AS BIGINT) AS weight,
             CAST(coalesce(v, 0) + floor(-1000.0::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
      FROM w LEFT JOIN v USING (doc_id) WHERE b = 0),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM s WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * able // 100 THEN place END AS rank FROM s LEFT JOIN o USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
