"""The queries of this package and, where SQL can say them, their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centwise.llm.collocations import collocations
from centwise.llm.decontaminate import contaminated
from centwise.llm.html_extraction import extract_text
from centwise.llm.line_dedup import line_report
from centwise.llm.minhash import near_duplicates
from centwise.llm.nn_descent import near_duplicate_vectors
from centwise.llm.packing import pack_documents
from centwise.llm.secret_scan import secret_scan
from centwise.llm.token_alignment import align_tokens
from centwise.llm.token_counts import token_counts
from centwise.llm.toxicity import toxicity
from centwise.llm.url_filters import filter_urls, host, path
from centwise.llm.warc_revisits import resolve_revisits

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_line_dedup(spark, d):
    found = line_report(_table(spark, d, "documents"))
    kept = F.array_join(F.transform("kept", lambda i: i.cast("string")), ",")
    return found.select("doc_id", "n_lines", F.size("kept").cast("bigint").alias("n_kept"), F.md5(kept).alias("kept_md5"))


def op2_token_counts(spark, d):
    return token_counts(_table(spark, d, "documents"))


def op3_minhash_near_dedup(spark, d):
    return near_duplicates(_table(spark, d, "documents"))


def op4_toxicity(spark, d):
    return toxicity(_table(spark, d, "documents"), _table(spark, d, "labels"))


def _hex(text, at: int, digits: int):
    """A number from 0 to 16^digits - 1 that a text stands for; both engines have md5."""
    return F.conv(F.substring(F.md5(text.cast("string")), at, digits), 16, 10).cast("bigint")


def _day(number):
    return F.timestamp_seconds(F.lit(1672531200) + number * 86400)


def captures(spark: SparkSession, d: str) -> DataFrame:
    """Every page as a capture of a day in 2023 or 2024."""
    pages = _table(spark, d, "pages").select("page_id", "url")
    return pages.select(F.col("page_id").alias("capture_id"), "url", _day(_hex(F.col("page_id"), 1, 4) % 730).alias("fetched"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Dated lists made from all pages: each host listed, taken off and, by some lists, listed again; each page's own path for some months."""
    pages = _table(spark, d, "pages").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    hosts = pages.select("host").distinct()
    names = F.explode(F.array(*(F.struct(F.lit(n).alias("list"), F.lit(v).alias("verdict"), F.lit(salt).alias("salt")) for n, v, salt in _LISTS))).alias("l")
    start = _hex(F.concat("host", "l.salt"), 1, 4) % 500
    length = _hex(F.concat("host", "l.salt"), 5, 4) % 300
    dated = F.explode(F.array(F.struct(start.alias("day"), F.lit("add").alias("action")), F.struct((start + length).alias("day"), F.lit("remove").alias("action")), F.struct((start + 2 * length).alias("day"), F.lit("add").alias("action")))).alias("e")
    by_host = hosts.select("host", names).select("host", "l", dated).select("l.list", "l.verdict", F.lit("domain").alias("kind"), F.col("host").alias("pattern"), _day(F.col("e.day")).alias("day"), "e.action")
    first = _hex(F.concat(F.lit("p"), F.col("page_id")), 1, 4) % 600
    verdict = F.when(_hex(F.col("page_id"), 9, 1) < 4, "allow").otherwise("block")
    pair = F.explode(F.array(F.struct(first.alias("day"), F.lit("add").alias("action")), F.struct((first + 120).alias("day"), F.lit("remove").alias("action")))).alias("e")
    by_page = pages.where("path <> ''").select(F.lit("pages").alias("list"), verdict.alias("verdict"), F.lit("prefix").alias("kind"), F.concat("host", F.regexp_replace("path", "/+$", "")).alias("pattern"), pair).select("list", "verdict", "kind", "pattern", _day(F.col("e.day")).alias("day"), "e.action")
    return by_host.union(by_page)


_LISTS = [("adult", "block", "a"), ("malware", "block", "m"), ("partners", "allow", "p")]


def op5_url_filters(spark, d):
    return filter_urls(captures(spark, d), entries(spark, d))


_PAGES = """SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path, md5(CAST(page_id AS VARCHAR)) AS h, md5('p' || page_id) AS hp FROM pages"""

OP5_SQL = f"""
WITH p AS ({_PAGES}),
lists(list, verdict, salt) AS (VALUES {', '.join(f"('{n}', '{v}', '{s}')" for n, v, s in _LISTS)}),
h AS (SELECT DISTINCT host FROM p),
hl AS (SELECT host, list, verdict, ('0x' || substr(md5(host || salt), 1, 4))::BIGINT % 500 AS a, ('0x' || substr(md5(host || salt), 5, 4))::BIGINT % 300 AS b FROM h, lists),
e AS (
  SELECT list, verdict, 'domain' AS kind, host AS pattern, a AS day, 'add' AS action FROM hl
  UNION ALL SELECT list, verdict, 'domain', host, a + b, 'remove' FROM hl
  UNION ALL SELECT list, verdict, 'domain', host, a + 2 * b, 'add' FROM hl
  UNION ALL SELECT 'pages', CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT < 4 THEN 'allow' ELSE 'block' END, 'prefix', host || regexp_replace(path, '/+$', ''), ('0x' || substr(hp, 1, 4))::BIGINT % 600 + x.n, x.action
    FROM p, (VALUES (0, 'add'), (120, 'remove')) x(n, action) WHERE path <> ''),
d AS (SELECT list, verdict, kind, pattern, day, min(action) AS action FROM e GROUP BY ALL),
c AS (SELECT page_id AS capture_id, host, ('0x' || substr(h, 1, 4))::BIGINT % 730 AS day, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p),
k AS (
  SELECT capture_id, day, 'domain' AS kind, array_to_string(labels[i:], '.') AS pattern, len(labels) - i + 1 AS rank FROM c, unnest(range(1, len(labels) + 1)) t(i)
  UNION ALL SELECT capture_id, day, 'prefix', host || '/' || array_to_string(parts[:i], '/'), 1000 + i FROM c, unnest(range(1, len(parts) + 1)) t(i)),
s AS (
  SELECT k.capture_id, k.rank, k.kind, k.pattern, d.list, d.verdict FROM k JOIN d ON d.kind = k.kind AND d.pattern = k.pattern AND d.day <= k.day
  WHERE d.action = 'add' AND NOT EXISTS (SELECT 1 FROM d n WHERE n.list = d.list AND n.verdict = d.verdict AND n.kind = d.kind AND n.pattern = d.pattern AND n.day > d.day AND n.day <= k.day)),
w AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY rank DESC, verdict DESC, list) AS place, count(*) OVER (PARTITION BY capture_id) AS n FROM s)
SELECT c.capture_id, c.host, coalesce(w.verdict, 'none') AS verdict, w.kind, w.pattern, w.list, coalesce(w.n, 0)::BIGINT AS n_active FROM c LEFT JOIN w ON w.capture_id = c.capture_id AND w.place = 1"""


def op6_packing(spark, d):
    return pack_documents(_table(spark, d, "documents"))


def op7_secret_scan(spark, d):
    return secret_scan(_table(spark, d, "documents"))


def op8_embedding_near_dedup(spark, d):
    return near_duplicate_vectors(_table(spark, d, "embeddings"))


def op9_benchmark_decontamination(spark, d):
    return contaminated(_table(spark, d, "documents"), _table(spark, d, "benchmark"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """Every page as one full response and three revisits of its URL, some under another spelling or with another validator."""
    page = _table(spark, d, "pages").select("page_id", "url", F.md5("html").alias("digest"), F.length("html").cast("bigint").alias("size"))
    turn = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("turn")
    p = page.select("*", turn)
    mark = F.concat("page_id", F.lit("-"), "turn")
    second = _hex(F.col("page_id"), 1, 5) + F.when(F.col("turn") > 0, _hex(mark, 1, 6) % 4_000_000 - 400_000).otherwise(0)
    etag = F.concat(F.lit('"'), F.substring(F.md5("url"), 1, 12), F.lit('"'))
    kind = _hex(mark, 9, 1)
    tag = F.when((F.col("turn") == 0) | (kind < 8), etag).when(kind < 10, F.concat(F.lit("W/"), etag)).when(kind < 12, F.lit('"other"'))
    spelled = F.when((F.col("turn") > 0) & (_hex(mark, 10, 1) < 8) & ~F.col("url").contains("#") & ~F.col("url").contains("?"), F.concat("url", F.lit("?utm_medium=feed"))).otherwise(F.col("url"))
    headers = F.map_filter(F.map_from_arrays(F.array(F.lit("ETag"), F.lit("Date"), F.lit("Content-Length")), F.array(tag, second.cast("string"), F.col("size").cast("string"))), lambda k, v: v.isNotNull())
    return p.select((F.col("page_id") * 4 + F.col("turn")).alias("record_id"), F.when(F.col("turn") == 0, "response").otherwise("revisit").alias("kind"), spelled.alias("url"), F.timestamp_seconds(F.lit(1672531200) + second).alias("fetched"), headers.alias("headers"), F.when(F.col("turn") == 0, F.col("digest")).alias("digest"), F.when(F.col("turn") == 0, F.col("size")).alias("size"))


def op10_warc_revisits(spark, d):
    found = resolve_revisits(records(spark, d))
    get = lambda k: F.element_at("headers", k)
    return found.select("record_id", "canonical", "response_id", "status", "digest", "size", get("etag").alias("etag"), get("date").alias("date"), get("content-length").alias("content_length"))


OP10_SQL = r"""
WITH t AS (SELECT page_id, url, md5(html) AS digest, length(html)::BIGINT AS size, turn, md5(page_id || '-' || turn) AS m, md5(CAST(page_id AS VARCHAR)) AS h FROM pages, unnest(range(4)) x(turn)),
r AS (
  SELECT page_id * 4 + turn AS record_id, turn, digest, size, ('0x' || substr(h, 1, 5))::BIGINT + CASE WHEN turn > 0 THEN ('0x' || substr(m, 1, 6))::BIGINT % 4000000 - 400000 ELSE 0 END AS sec,
    CASE WHEN turn > 0 AND ('0x' || substr(m, 10, 1))::BIGINT < 8 AND NOT contains(url, '#') AND NOT contains(url, '?') THEN url || '?utm_medium=feed' ELSE url END AS url,
    CASE WHEN turn = 0 OR ('0x' || substr(m, 9, 1))::BIGINT < 8 THEN '"' || substr(md5(url), 1, 12) || '"' WHEN ('0x' || substr(m, 9, 1))::BIGINT < 10 THEN 'W/"' || substr(md5(url), 1, 12) || '"' WHEN ('0x' || substr(m, 9, 1))::BIGINT < 12 THEN '"other"' END AS etag
  FROM t),
q AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', ''), ':(80|443)?$', '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS query FROM r),
c AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM q),
j AS (SELECT v.*, b.record_id AS response_id, b.digest AS b_digest, b.size AS b_size, b.etag AS b_etag, b.sec AS b_sec,
    row_number() OVER (PARTITION BY v.record_id ORDER BY b.sec DESC, b.record_id DESC) AS place
  FROM c v LEFT JOIN c b ON b.turn = 0 AND b.canonical = v.canonical AND b.sec < v.sec WHERE v.turn > 0),
s AS (SELECT *, CASE WHEN response_id IS NULL THEN 'missing' WHEN etag IS NULL THEN 'unverified' WHEN replace(etag, 'W/', '') = replace(b_etag, 'W/', '') THEN 'resolved' ELSE 'changed' END AS status FROM j WHERE place = 1)
SELECT record_id, canonical, response_id, status, CASE WHEN status = 'resolved' THEN b_digest END AS digest, CASE WHEN status = 'resolved' THEN b_size END AS size,
  CASE WHEN status = 'resolved' THEN etag END AS etag, CASE WHEN status = 'resolved' THEN sec::VARCHAR END AS date, CASE WHEN status = 'resolved' THEN b_size::VARCHAR END AS content_length FROM s"""

def op11_html_extraction(spark, d):
    return extract_text(_table(spark, d, "pages"))


def op12_token_alignment(spark, d):
    return align_tokens(_table(spark, d, "documents"))


def op13_phrase_collocations(spark, d):
    return collocations(_table(spark, d, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
u AS (SELECT lang, unnest(list_concat(
    list_transform(range(1, len(w) + 1), lambda i: w[i:i]), list_transform(range(1, len(w)), lambda i: w[i:i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))) AS words FROM p),
g AS MATERIALIZED (SELECT lang, len(words) AS k, array_to_string(words, ' ') AS phrase, any_value(words) AS words, count(*) AS f FROM u GROUP BY 1, 2, 3 HAVING count(*) >= 10),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY 1),
c AS (SELECT * FROM g WHERE k > 1 AND f >= 10),
h AS MATERIALIZED (SELECT lang, k, phrase, f AS a, part, array_to_string(words[:part], ' ') AS front, array_to_string(words[part + 1:], ' ') AS back
  FROM (SELECT *, unnest(range(1, k)) AS part FROM c)),
b AS (SELECT h.lang, h.k, h.phrase, a, part, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM h JOIN g l ON l.lang = h.lang AND l.phrase = front JOIN g r ON r.lang = h.lang AND r.phrase = back),
s AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, part) = 1),
e AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, array_to_string(words[1:2], ' ') AS phrase, f FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(words[2:3], ' '), f FROM c WHERE k = 3) GROUP BY 1, 2),
o AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank FROM s LEFT JOIN e ON s.k = 2 AND e.lang = s.lang AND e.phrase = s.phrase WHERE e.f IS NULL OR 100 * e.f < 50 * s.a)
SELECT o.lang, rank::BIGINT AS rank, phrase, a, l, r, t.n, score FROM o JOIN t USING (lang) WHERE rank <= 2000"""

OP1_SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, list_filter(string_split_regex(lower(lines[i]), '[\x09-\x0D\x20]+'), lambda t: t <> '') AS raw
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d, unnest(range(1, len(lines) + 1)) u(i)),
t AS (SELECT doc_id, line_no, list_sort(list_distinct(raw)) AS tokens FROM l WHERE len(raw) > 0),
c AS (SELECT row_number() OVER (ORDER BY pos) AS id, * FROM (SELECT tokens, len(tokens) AS n, min((doc_id, line_no)) AS pos FROM t GROUP BY tokens)),
x AS (SELECT id, n, pos, unnest(tokens) AS token FROM c),
p AS (SELECT a.id AS early, b.id AS late, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.token = b.token AND a.pos < b.pos AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
gone AS (SELECT DISTINCT late FROM p WHERE 100 * k >= 80 * (na + nb - k)),
k AS (SELECT pos[1] AS doc_id, pos[2] AS line_no FROM c WHERE id NOT IN (SELECT late FROM gone)),
g AS (SELECT doc_id, count(*) AS n_kept, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS kept FROM k GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_kept, 0)::BIGINT AS n_kept, md5(coalesce(kept, '')) AS kept_md5
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_token_counts, op3_minhash_near_dedup, op4_toxicity, op5_url_filters, op6_packing, op7_secret_scan, op8_embedding_near_dedup, op9_benchmark_decontamination, op10_warc_revisits, op11_html_extraction, op12_token_alignment, op13_phrase_collocations)
}
CHECK_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op5_url_filters": OP5_SQL, "op10_warc_revisits": OP10_SQL, "op13_phrase_collocations": OP13_SQL}
