"""One query per operator over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fingerprint, licenses, mixing, near_dedup, quality, substring_dedup, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash near-duplicates of all documents."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {"op1_near_dedup": op1_near_dedup}

_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op1_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id,
  coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
""",
}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, no source beyond twice its size."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


QUERIES["op10_mixing"] = op10_mixing
ORACLES["op10_mixing"] = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, source,
  md5(concat_ws(':', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS k,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM s0),
s2 AS (SELECT *, CAST([3, 1, 2][(src - 1) % 3 + 1] AS DOUBLE) AS w, n * 2.0 AS most FROM s1),
s3 AS (SELECT *, most / w AS ratio, (1.5 * sum(n) OVER () - (sum(most) OVER (ORDER BY most / w, src) - most))
  / sum(w) OVER (ORDER BY most / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
l AS (SELECT (SELECT level FROM s3 WHERE level <= ratio ORDER BY ratio, src LIMIT 1) AS level),
s4 AS (SELECT s3.* EXCLUDE (level), coalesce(least(most, w * l.level), most) AS target FROM s3, l),
s5 AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota,
  CASE WHEN target > 0 THEN CAST(ceil(target) AS BIGINT) + 2048 ELSE 0 END AS part FROM s4),
s6 AS (SELECT *, CAST(sum(part) OVER (ORDER BY src) AS BIGINT) AS top, CAST(sum(part) OVER () AS BIGINT) AS tot FROM s5),
s AS (SELECT *, CAST(floor(CAST(top - part AS DOUBLE) / tot * 2147483648.0) AS BIGINT) AS low,
  CAST(floor(CAST(top AS DOUBLE) / tot * 2147483648.0) AS BIGINT) AS high FROM s6),
slots AS (SELECT i, ((i % 2147483648) * 1327217885) % 2147483648 AS p FROM
  (SELECT unnest(range((SELECT CAST(ceil(max(tot) / 256.0) AS BIGINT) FROM s))) AS i)),
ranked AS (SELECT s.src, row_number() OVER (PARTITION BY s.src ORDER BY i) - 1 AS r FROM slots JOIN s ON p >= low AND p < high),
most AS (SELECT src, count(*) AS slots FROM ranked GROUP BY src),
docs AS (SELECT d.*, s.src, s.n, s.target, least(s.quota, coalesce(m.slots, 0) * 256) AS quota,
  sum(size) OVER (PARTITION BY s.src ORDER BY k ROWS UNBOUNDED PRECEDING) - size AS a
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN most m ON m.src = s.src)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target, source,
  CAST(greatest(0, least(a + size, quota) - a) + greatest(0, least(n + a + size, quota) - (n + a)) AS BIGINT) AS taken
FROM docs
"""


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.compare_with_next(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of all documents without bytes in repeated strings of 400 bytes."""
    return substring_dedup.repeat_report(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of all pages."""
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of the benchmark that documents hold."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES |= {"op4_fingerprint": op4_fingerprint, "op5_substring_dedup": op5_substring_dedup, "op6_url_filter": op6_url_filter, "op7_decontaminate": op7_decontaminate}
ORACLES["op6_url_filter"] = """
WITH r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
b(host) AS (VALUES ('ads-track.example.com'), ('adult-x.example.net'), ('casino-win.example.com'), ('cheap-pills.example.com'), ('free-bets.example.com'), ('spam-farm.example.com')),
u AS (SELECT row_number() OVER () AS id, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT id, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT p.id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict,
  CASE WHEN EXISTS (SELECT 1 FROM b WHERE p.host = b.host OR ends_with(p.host, '.' || b.host)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f USING (id)
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES |= {"op8_quality": op8_quality, "op9_toxicity": op9_toxicity}


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence digests of all documents."""
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of all conversations as canonical JSON messages."""
    return chat.format_chat(_table(spark, sf_dir, "conversations"))


QUERIES |= {"op2_license_scan": op2_license_scan, "op3_chat": op3_chat}


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    words = rf"regexp_replace(' ' || regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') || ' ', ' *\n *', chr(32) || chr(10) || chr(32), 'g')"
    for a, b in licenses.SPELLINGS:
        words = f"replace({words}, ' {a} ', ' {b} ')"
    return f"list_filter(list_transform(string_split({words}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^(copyright( c)? [0-9]|c [0-9]{{4}}|all rights reserved)'))"


ORACLES["op2_license_scan"] = f"""
WITH k(license, text) AS (VALUES {", ".join(f"({_literal(i)}, {_literal(t)})" for i, t in licenses.KNOWN)}),
known AS (SELECT sha256(b) AS digest, min(license) AS license FROM (SELECT license, array_to_string({_canonical("text")}, ' ') AS b FROM k) GROUP BY 1),
listed AS (SELECT digest, min(license) AS license FROM (FROM known UNION ALL SELECT digest, license FROM (VALUES {", ".join(f"({_literal(i)}, {_literal(t)})" for i, t in licenses.DIGESTS)}) t(license, digest)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS id, doc_id, {_canonical("coalesce(text, '')")} AS lines FROM documents),
n AS (SELECT id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT id, unnest(lines) AS line FROM d) JOIN known ON digest = sha256(line) GROUP BY id)
SELECT d.doc_id, sha256(array_to_string(d.lines, ' ')) AS digest, listed.license, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN listed ON listed.digest = sha256(array_to_string(d.lines, ' ')) LEFT JOIN n USING (id)
"""

# The conversations hold no tool calls; linking is tested on fixtures.
ORACLES["op3_chat"] = """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position,
  CAST(NULL AS BIGINT) AS linked_turn, 'ok' AS status, CAST(json_object('content', text, 'role', role) AS VARCHAR) AS message
FROM conversations
"""

# Bytes are pairs of hexadecimal digits here; strings are compared by a 64-bit hash.
ORACLES["op5_substring_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT id, h, unnest(range(length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800),
w AS (SELECT id, i, hash(substr(h, 2 * i + 1, 800)) AS w FROM p),
r AS (SELECT id, i FROM w QUALIFY count(*) OVER (PARTITION BY w) > 1),
s AS (SELECT id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY id ORDER BY i) + 400 THEN 0 ELSE 1 END AS n FROM r),
g AS (SELECT id, i, sum(n) OVER (PARTITION BY id ORDER BY i) AS k FROM s),
spans AS (SELECT id, k, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY id, k),
n AS (SELECT id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last FROM spans GROUP BY id),
pieces AS (SELECT id, a AS place, coalesce(lag(b) OVER (PARTITION BY id ORDER BY a), 0) AS lo, a AS hi FROM spans UNION ALL SELECT id, last, last, NULL FROM n),
kept AS (SELECT d.id, string_agg(CASE WHEN hi IS NULL THEN substr(h, 2 * lo + 1) ELSE substr(h, 2 * lo + 1, 2 * (hi - lo)) END, '' ORDER BY place) AS h FROM pieces JOIN d USING (id) GROUP BY d.id)
SELECT doc_id, length(d.h) // 2 AS n_bytes, CAST(coalesce(n.removed, 0) AS BIGINT) AS n_removed, coalesce(n.spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n.id IS NULL THEN d.h ELSE kept.h END)) AS kept_sha256
FROM d LEFT JOIN n USING (id) LEFT JOIN kept USING (id)
"""
