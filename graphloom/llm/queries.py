"""The operators' queries over the driver's tables, and SQL for those that SQL can express.

Each query applies its operator to the whole table with production parameters and derives the digest columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, html, jaccard, jpeg, lm, packing, quality, revisits, sharding, substrings
from .common import read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(documents, quality.learning_labels(read(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    score = F.col(quality.SCORE)
    return quality.score(documents, model).select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_apart(read(spark, sf_dir, "documents"))


def op3_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.sliced_digests(read(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.duplicate_spans(read(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"), "n_backed_off")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_bytes(read(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("leaked", "h")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def captures(pages: DataFrame) -> DataFrame:
    """Captures as a crawler would have stored them: of each page a full response and, some time later or just
    before it, a revisit by another spelling of the URL, with validators that differ for some."""
    rows = pages.select("page_id", "url", "html", F.md5(F.col("html").cast("binary")).alias("tag"), (F.pmod(F.col("page_id") * 7919, F.lit(2_592_000))).alias("at"))
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    seven = F.col("page_id") % 7
    full = F.array(
        header("ETag", F.concat(F.lit('"'), "tag", F.lit('"'))), header("Last-Modified", F.col("at").cast("string")), header("Content-Type", F.lit("text/html")),
        header("Content-Length", F.octet_length("html").cast("string")), header("Cache-Control", F.lit("max-age=60")),
    )
    validator = F.when(seven == 0, F.array(header("ETag", F.lit('"other"')))).when(seven == 1, F.array(header("last-modified", F.col("at").cast("string")))).when(seven == 2, F.array(header("Date", F.lit("now")))).otherwise(F.array(header("etag", F.concat(F.lit('W/"'), "tag", F.lit('"')))))
    renewed = F.concat(validator, F.array(header("Cache-Control", F.lit("max-age=600")), header("Content-Length", F.lit("0"))))
    responses = rows.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("at").alias("ts"), F.lit(200).alias("status"), full.alias("headers"), F.col("html").alias("payload"))
    later = F.when(F.col("page_id") % 5 == 0, F.col("at") - 1).otherwise(F.col("at") + 1000)
    again = rows.select((F.col("page_id") * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), later.alias("ts"), F.lit(304).alias("status"), renewed.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return responses.unionByName(again)


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(captures(read(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.select("record_id", F.col("key").alias("url_key"), "response_id", "outcome", lines.alias("headers"), F.md5(F.col("payload").cast("binary")).alias("payload_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_packing, op3_jpeg, op4_substrings, op5_lm, op6_jaccard, op7_sharding, op8_decontamination, op9_html, op10_revisits)
}

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"

ORACLES: dict[str, str] = {
    # CRC-32 byte by byte, from its table
    "op7_sharding": r"""
WITH RECURSIVE bits AS (SELECT 0 AS k, i AS b, CAST(i AS BIGINT) AS c FROM range(256) AS x(i)
  UNION ALL SELECT k + 1, b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
h AS (SELECT DISTINCT coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT text, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || x[2*i+1:2*i+2] AS BIGINT))),
  lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS INTEGER) + 1]))) AS text_crc32 FROM h, crc),
d AS (SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, coalesce(text, '') AS text, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS k FROM documents),
p AS (SELECT *, sum(size) OVER (ORDER BY k, doc_id NULLS FIRST, r ROWS UNBOUNDED PRECEDING) AS stop FROM d),
b AS (SELECT i, arg_min(stop, struct_pack(far := abs(stop - i * total / 16), e := stop)) AS cut
  FROM (SELECT stop FROM p UNION ALL SELECT 0), (SELECT i FROM range(1, 16) AS y(i)), (SELECT CAST(sum(size) AS DOUBLE) AS total FROM d) GROUP BY i),
s AS (SELECT p.*, (SELECT count(*) FROM b WHERE cut <= stop - size) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY stop) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s JOIN c USING (text)""",
    "op5_lm": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, w FROM d WHERE len(w) > 0),
g AS (SELECT r, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i-1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i-2] || ' ' || w[i-1] || ' ' || w[i] END AS g3,
  CASE WHEN i > 1 THEN w[i-1] END AS h1, CASE WHEN i > 2 THEN w[i-2] || ' ' || w[i-1] END AS h2 FROM t),
n AS (SELECT count(*) AS n FROM g), c1 AS (SELECT g1 AS g, count(*) AS c FROM g GROUP BY 1), c2 AS (SELECT g2 AS g, count(*) AS c FROM g WHERE g2 IS NOT NULL GROUP BY 1),
c3 AS (SELECT g3 AS g, count(*) AS c FROM g WHERE g3 IS NOT NULL GROUP BY 1),
s AS (SELECT r, ln(a.c / n.n) AS u, b.c AS b, e.c AS t, hb.c AS hb, ht.c AS ht, g2, g3 FROM g, n JOIN c1 a ON a.g = g.g1 LEFT JOIN c2 b ON b.g = g2 LEFT JOIN c3 e ON e.g = g3 LEFT JOIN c1 hb ON hb.g = h1 LEFT JOIN c2 ht ON ht.g = h2),
v AS (SELECT *, CASE WHEN g2 IS NULL THEN u WHEN b >= 2 THEN ln(b / hb) ELSE u + ln(0.4) END AS two, CASE WHEN g2 IS NOT NULL AND b < 2 THEN 1 ELSE 0 END AS back FROM s),
z AS (SELECT r, CASE WHEN g3 IS NULL THEN two WHEN t >= 2 THEN ln(t / ht) ELSE two + ln(0.4) END AS x, CASE WHEN g3 IS NULL THEN back WHEN t >= 2 THEN 0 ELSE 1 END AS back FROM v),
p AS (SELECT r, count(*) AS n, sum(x) AS x, sum(back) AS back FROM z GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(x, 0), 4) AS log_score, round(x / n, 6) AS mean_log_score, CAST(coalesce(back, 0) AS BIGINT) AS n_backed_off
FROM d LEFT JOIN p USING (r)""",
    "op6_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, trim(coalesce(text, '')) AS text, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, text, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
k AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN array_to_string(s, '|') ELSE '-' || text END AS k, s FROM s),
c AS (SELECT k, min(doc_id) AS id, any_value(s) AS s FROM k GROUP BY k),
e AS (SELECT id, len(s) AS n, unnest(s) AS x FROM c WHERE len(s) > 0),
p AS (SELECT l.id AS a, r.id AS b, count(*) AS m, any_value(l.n) AS na, any_value(r.n) AS nb FROM e l JOIN e r ON l.x = r.x AND l.id < r.id GROUP BY 1, 2),
h AS (SELECT a, b FROM p WHERE m >= 0.8 * (na + nb - m)), u AS (SELECT a, b FROM h UNION SELECT b, a FROM h),
reach AS (SELECT a AS id, a AS root FROM u UNION SELECT reach.id, u.b FROM reach JOIN u ON u.a = reach.root),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id), degree AS (SELECT a AS id, count(*) AS n FROM u GROUP BY a)
SELECT k.doc_id, coalesce(roots.root, c.id) AS class_id, c.id AS copy_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links
FROM k JOIN c USING (k) LEFT JOIN roots ON roots.id = c.id LEFT JOIN degree ON degree.id = c.id""",
    "op8_decontamination": r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 13) AS n, array_to_string(w[p:p+12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT r, p, n, array_to_string(w[p:p+n-1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM w, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT DISTINCT r, p, n, item FROM d JOIN v USING (n, g)),
hit AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM h) GROUP BY 1),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY 1),
t AS (SELECT r, generate_subscripts(w, 1) AS p, unnest(w) AS t FROM w),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(w, ' ') AS g, unnest(w) AS t FROM i),
c AS (SELECT t, count(*) AS n FROM t WHERE t IN (SELECT t FROM b) GROUP BY t),
k AS (SELECT item, g, t, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY item, g ORDER BY coalesce(n, 0), encode(t)) AS k FROM b LEFT JOIN c USING (t)),
q AS (SELECT item, g, max(k) - 1 AS others, min(n) AS least FROM k WHERE k <= 4 GROUP BY item, g HAVING max(k) > 1 AND min(n) > 0),
a AS (SELECT t.r, q.item, q.g, q.others, t.p FROM q JOIN k ON k.item IS NOT DISTINCT FROM q.item AND k.g = q.g AND k.k = 1 JOIN t ON t.t = k.t),
o AS (SELECT t.r, k.item, k.g, k.t, t.p FROM q JOIN k ON k.item IS NOT DISTINCT FROM q.item AND k.g = q.g AND k.k BETWEEN 2 AND 4 JOIN t ON t.t = k.t),
f AS (SELECT a.r, a.item, a.g, a.p, a.others FROM a JOIN o ON a.r = o.r AND a.item IS NOT DISTINCT FROM o.item AND a.g = o.g AND abs(a.p - o.p) <= 12 GROUP BY ALL HAVING count(DISTINCT o.t) = a.others),
m AS (SELECT r, count(DISTINCT item) AS n_near FROM f GROUP BY r)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM w LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN m USING (r)""",
    "op10_revisits": r"""
WITH p AS (SELECT page_id, html, md5(html) AS tag, ((page_id * 7919) % 2592000) AS sec, url,
  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS bare FROM pages),
k AS (SELECT *, regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', '') || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS front,
  list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid|ref)='))) AS q FROM p),
c AS (SELECT *, front || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key, CASE WHEN page_id % 5 = 0 THEN sec - 1 ELSE sec + 1000 END AS later FROM k),
m AS (SELECT r.page_id, max(struct_pack(t := f.sec, i := f.page_id)) AS best FROM c r JOIN c f ON f.key = r.key AND f.sec < r.later GROUP BY 1),
j AS (SELECT r.page_id, r.key, r.tag, r.sec, f.page_id AS fid, f.tag AS ftag, f.sec AS fsec, f.html AS body FROM c r LEFT JOIN m ON m.page_id = r.page_id LEFT JOIN c f ON f.page_id = m.best.i),
o AS (SELECT *, CASE WHEN fid IS NULL THEN 'orphan' WHEN page_id % 7 = 0 THEN 'changed' WHEN page_id % 7 = 1 THEN CASE WHEN sec = fsec THEN 'merged' ELSE 'changed' END WHEN page_id % 7 = 2 THEN 'merged' WHEN tag = ftag THEN 'merged' ELSE 'changed' END AS outcome FROM j)
SELECT page_id * 2 + 1 AS record_id, key AS url_key, fid * 2 AS response_id, outcome,
  CASE WHEN outcome = 'merged' THEN array_to_string(list_sort(list_filter(['cache-control: max-age=600', 'content-length: ' || strlen(body), 'content-type: text/html',
    CASE WHEN page_id % 7 = 2 THEN 'date: now' END, CASE WHEN page_id % 7 <= 2 THEN 'etag: "' || ftag || '"' ELSE 'etag: W/"' || tag || '"' END, 'last-modified: ' || CASE WHEN page_id % 7 = 1 THEN sec ELSE fsec END], lambda x: x IS NOT NULL)), chr(10))
  ELSE array_to_string(list_sort(['cache-control: max-age=600', 'content-length: 0', CASE WHEN page_id % 7 = 0 THEN 'etag: "other"' WHEN page_id % 7 = 1 THEN 'last-modified: ' || sec WHEN page_id % 7 = 2 THEN 'date: now' ELSE 'etag: W/"' || tag || '"' END]), chr(10)) END AS headers,
  CASE WHEN outcome = 'merged' THEN md5(body) END AS payload_md5
FROM o""",
}
