"""The numbered queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm import pieces
from factmill.llm.codebooks import ENTRIES, PARTS, ROUNDS, coded_vectors
from factmill.llm.ctw import score_documents
from factmill.llm.langid import fit, identify_documents, identify_pages
from factmill.llm.mixing import mix
from factmill.llm.passages import quality_scores
from factmill.llm.sharding import hilbert_shards
from factmill.llm.simhash import fingerprint_hex, near_groups
from factmill.llm.sketch import fingerprint_edits
from factmill.llm.topk import exact_top_k
from factmill.llm.trie import EMPTY_SHA256, conversation_trie
from factmill.llm.urlfilter import judge_urls, page_links
from factmill.llm.warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in shards 0 to 7 along a Hilbert curve over source, language and length; law: rows."""
    docs = table(spark, sf_dir, "documents")
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    carry = [F.col("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32")]
    out = hilbert_shards(docs, ["source", "lang", "n_chars"], 8, carry, ["text_crc32", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


#: Host, path and verdict of the rules that op2 is told to apply.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op2_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages under URL_RULES, with verdicts spread over redirects and canonical links."""
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules, page_links(pages)).select("page_id", "host", "path", "rule", "verdict", "alias_group", "basis")


_FOUND = "substr({0}, strpos({0}, '://') + 3)"


def _host(url: str) -> str:
    found = f"CASE WHEN strpos({url}, '://') > 0 THEN {_FOUND.format(url)} ELSE '' END"
    return f"coalesce(translate(regexp_extract({found}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"


def _path(url: str) -> str:
    return f"coalesce(CASE WHEN strpos({url}, '://') > 0 THEN regexp_extract({_FOUND.format(url)}, '^[^/?#]*([^?#]*)', 1) ELSE '' END, '')"


def _key(url: str) -> str:
    scheme = f"translate(split_part({url}, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"CASE WHEN {_host(url)} <> '' THEN {scheme} || '://' || {_host(url)} || {_path(url)} || regexp_extract({_FOUND.format(url)}, '^[^?#]*([?][^#]*)', 1) END"


#: Declared links as tags of the html, their targets as whole urls, components by reaching out, rules as suffixes and prefixes.
OP2_SQL = rf"""
WITH RECURSIVE rules(h, s, v) AS (VALUES {", ".join(f"('{h}', '{s}', '{v}')" for h, s, v in URL_RULES)}),
p AS MATERIALIZED (SELECT page_id, url, {_host("url")} AS host, {_path("url")} AS path, {_key("url")} AS key, html FROM pages),
tags AS (SELECT p.*, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*')) AS tag FROM p),
named AS (
  SELECT p.*, CASE WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)^.*\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)^.*\burl\s*=\s*["'']?([^"''\s>;]+)', 1) END AS t FROM tags p),
whole AS (
  SELECT key, CASE WHEN contains(t, '://') THEN t WHEN host = '' THEN NULL WHEN t LIKE '//%' THEN split_part(url, '://', 1) || ':' || t WHEN t LIKE '/%' THEN split_part(url, '://', 1) || '://' || host || t
    WHEN NOT regexp_matches(t, '^(?:[A-Za-z][A-Za-z0-9+.-]*:|[?#])') THEN split_part(url, '://', 1) || '://' || host || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || t END AS dst FROM named WHERE t <> ''),
links AS (SELECT key AS a, {_key("dst")} AS b FROM whole WHERE key IS NOT NULL AND {_key("dst")} IS NOT NULL),
edges AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach AS (SELECT DISTINCT a AS node, a AS met FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.met),
groups AS (SELECT node, min(met) AS component FROM reach GROUP BY node),
urls AS (SELECT DISTINCT host, path FROM (SELECT host, path FROM p UNION ALL SELECT {_host("node")}, {_path("node")} FROM groups)),
ruled AS (
  SELECT host, path, h || s AS rule, v FROM urls JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, s)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(h || s) DESC, v) = 1),
bad AS (SELECT DISTINCT component FROM groups JOIN ruled ON ruled.host = {_host("node")} AND ruled.path = {_path("node")} WHERE v = 'block')
SELECT page_id, p.host, p.path, rule, coalesce(v, CASE WHEN bad.component IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, groups.component AS alias_group,
  CASE WHEN v IS NOT NULL THEN 'rule' WHEN bad.component IS NOT NULL THEN 'alias' ELSE 'default' END AS basis
FROM p LEFT JOIN ruled USING (host, path) LEFT JOIN groups ON groups.node = p.key LEFT JOIN bad USING (component)
"""


def op3_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every text of documents and of its edited text."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages archived as WARC, read back and assembled into captures."""
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS keep FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM k
"""


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all embeddings for each whose vec_id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
"""


def op7_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model learnt from nine tenths of them."""
    return score_documents(table(spark, sf_dir, "documents"))


def op8_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed, the sources weighing 5, 2, 1 in turn."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("take") * F.col("size")).alias("taken"), "copies")


def op9_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op10_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents and pages, by ``table``. Documents have a text, a declared language and a source that
    stands for the host; pages have visible text, the language that the markup declares, and the suffix, domain and host
    of their address. One text model, learnt from the documents' labels, serves both; the evidence of each table is its
    own."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = fit(docs.select("doc_id", "text", "lang"))
    none = F.lit(None).cast("long")
    of_docs = identify_documents(docs, ["doc_id"], model).select(F.lit("documents").alias("table"), "row.doc_id", none.alias("page_id"), "language.*")
    of_pages = identify_pages(pages, model, ["page_id"]).select(F.lit("pages").alias("table"), none.alias("doc_id"), "row.page_id", "language.*")
    return of_docs.unionByName(of_pages)


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all pages, from visible text, the markup's language and the url's host; labels are documents'."""
    model = fit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return identify_pages(table(spark, sf_dir, "pages"), model, ["page_id"]).select("row.page_id", "language.*")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as product codes over integer codebooks learnt from them."""
    return coded_vectors(table(spark, sf_dir, "embeddings"))


def _op11_sql() -> str:
    """Codebooks b0, b1, ... of the rounds, each from the assignment a0, a1, ... by the one before."""
    near = "SELECT p.*, b.j, list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS d FROM p JOIN b{r} b USING (part) QUALIFY row_number() OVER (PARTITION BY p.vec_id, part ORDER BY d, j) = 1"
    means = "SELECT part, j, list(m ORDER BY pos) AS c FROM (SELECT part, j, pos, floor(sum(x[pos]) / count(*)) AS m FROM a{r}, range(1, len(x) + 1) s(pos) GROUP BY ALL) GROUP BY ALL"
    steps = [f"a{r} AS MATERIALIZED ({near.format(r=r)}), b{r + 1} AS MATERIALIZED (SELECT o.part, o.j, coalesce(n.c, o.c) AS c FROM b{r} o LEFT JOIN ({means.format(r=r)}) n USING (part, j))" for r in range(ROUNDS)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, e[part * len(e) // {PARTS} + 1:(part + 1) * len(e) // {PARTS}] AS x FROM v, range({PARTS}) t(part)),
b0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS j, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES})),
{", ".join(steps)},
f AS ({near.format(r=ROUNDS)}),
o AS (SELECT vec_id, string_agg(printf('%02x', j), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, j)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id), h
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: A CRC-32 bit by bit; nodes are named by the digests of their turns, and each is met with all nodes below it.
OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t),
c AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(8 * len(s)), lambda i: (ascii(s[i // 8 + 1]) >> (i % 8)::INTEGER) & 1)),
    lambda x, y: xor(x >> 1, CASE WHEN xor(x, y) & 1 = 1 THEN 3988292384 ELSE 0 END))) % 9 AS h FROM b),
r AS (
  SELECT c.conv_id, t.k, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.k <= c.h
  UNION ALL SELECT c.conv_id, t.k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, md5(len(role) || ':' || role || text) AS m, strlen(text) AS n FROM r),
w AS MATERIALIZED (
  SELECT conv_id, depth, n, md5(string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM d
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
z AS (SELECT conv_id, max(depth) AS depth FROM w GROUP BY conv_id),
g AS MATERIALIZED (SELECT node, depth, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs FROM w GROUP BY node, depth),
u AS MATERIALIZED (SELECT DISTINCT w.node, v.node AS up FROM w JOIN w v ON w.conv_id = v.conv_id AND w.depth = v.depth + 1),
k AS MATERIALIZED (SELECT up AS node, count(*) AS n_children FROM u GROUP BY up),
s AS (
  SELECT up.node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum((g.n_convs - 1) * g.n)::BIGINT AS saved_tokens
  FROM (SELECT DISTINCT a.node, b.node AS low FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.depth <= b.depth) up JOIN g ON g.node = up.low LEFT JOIN k ON k.node = up.low GROUP BY up.node),
e AS (SELECT w.node, sha256(string_agg(w.conv_id::VARCHAR, ',' ORDER BY w.conv_id)) AS ends FROM w JOIN z USING (conv_id, depth) GROUP BY w.node)
SELECT g.conv_id, g.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, g.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends, '{EMPTY_SHA256}') AS ends_sha256
FROM g JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN e USING (node) LEFT JOIN u USING (node) LEFT JOIN g p ON p.node = u.up
"""


def op13_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, by attention over their passages, learnt from labels."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_hilbert_sharding, op2_redirect_equivalence, op3_scaled_sketch, op4_simhash_near_dedup, op5_warc_transactions, op6_exact_top_k, op7_context_tree_weighting, op8_pareto_mixing, op9_sentencepiece_scan, op10_language_fusion, op11_vector_codes, op12_conversation_trie, op13_attention_quality, page_languages)}
ORACLE_SQL: dict[str, str] = {"op2_redirect_equivalence": OP2_SQL, "op5_warc_transactions": OP5_SQL, "op6_exact_top_k": OP6_SQL, "op11_vector_codes": _op11_sql(), "op12_conversation_trie": OP12_SQL}
