"""The operators over the driver's tables, with their SQL for DuckDB.

The tables hold no provider data, so each operator runs on the closest column. Column names of both sides agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factmill.functions import contact, stats, text, urls
from factmill.operators import coerce, evaluation, jobs, profiles, rollups, usage
from factmill.plans import oracle
from factmill.plans.registry import query, table
from factmill.sources.files import spread


# Text.


def _texts(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"""SELECT lang, count(*) AS documents, count(*) FILTER (WHERE NOT {oracle.unsafe('t')} AND NOT {oracle.placeholder('t')}) AS safe
FROM (SELECT lang, {oracle.clean('text')} AS t FROM documents) GROUP BY lang""")
def safe_documents_by_lang(spark, sf_dir):
    """Documents of each language that hold nothing unsafe or made up."""
    docs = spread(table(spark, sf_dir, "documents").select("lang", "text")).select("lang", text.safe_fact(F.col("text"), None).alias("t"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count("t").alias("safe"))


@query(f"SELECT doc_id, {oracle.clean('text')} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", text.clean_public_text(F.col("text"), None).alias("cleaned"))


@query(f"SELECT doc_id, {oracle.unsafe('text')} AS unsafe, contains(text, '@') AS has_address FROM documents")
def unsafe_content_flags(spark, sf_dir):
    t = F.col("text")
    return _texts(spark, sf_dir).select("doc_id", text.contains_unsafe(t).alias("unsafe"), t.contains("@").alias("has_address"))


@query(f"SELECT doc_id, {oracle.placeholder('text')} AS placeholder FROM documents")
def placeholder_flags(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", text.contains_placeholder(F.col("text")).alias("placeholder"))


@query("""SELECT source_id, count(*) AS n FROM (SELECT coalesce(nullif(regexp_replace(regexp_replace(left(trim(source), 80), '[^a-zA-Z0-9_.:-]', '-', 'g'), '-+', '-', 'g'), ''), 'none') AS source_id FROM documents) GROUP BY source_id""")
def safe_source_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(text.safe_source_id(F.col("source"), F.lit("none")).alias("source_id"))
    return docs.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT key, p_partkey, p_retailprice FROM (
  SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key, p_partkey, p_retailprice,
    row_number() OVER (PARTITION BY key ORDER BY p_retailprice, p_partkey) AS n FROM part) WHERE n = 1""")
def fact_key_dedupe(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(text.fact_key(F.col("p_name")).alias("key"), "p_partkey", "p_retailprice")
    return profiles.dedupe_ranked(parts, ["key"], ["p_retailprice", "p_partkey"]).select("key", "p_partkey", "p_retailprice")


@query("""SELECT kind, trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', ' ', 'g')) AS identity FROM (
  SELECT 'customer' AS kind, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier)""")
def name_identity(spark, sf_dir):
    both = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name")).union(table(spark, sf_dir, "supplier").select(F.lit("supplier"), "s_name"))
    return both.select("kind", text.name_identity(F.col("name")).alias("identity"))


@query("""SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g'), ' '),
  lambda t: length(t) >= 3 AND NOT list_contains(['the', 'and', 'for', 'doctor', 'dr', 'md', 'do', 'provider', 'medical', 'health'], t))) AS token FROM part) GROUP BY token""")
def name_tokens(spark, sf_dir):
    found = table(spark, sf_dir, "part").select(F.explode(profiles.name_tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("token"))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


PHONE = r"\+?\d[\d ().-]{7,16}\d"


@query(f"""SELECT doc_id, phone, CASE WHEN length(d) = 11 AND d LIKE '1%' THEN substr(d, 2) ELSE d END AS digits, length(d) BETWEEN 7 AND 15 AS fits FROM (
  SELECT doc_id, phone, regexp_replace(phone, '\\D', '', 'g') AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{PHONE}')) AS phone FROM documents))""")
def phone_digits(spark, sf_dir):
    """Every phone number of each document."""
    found = _texts(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(PHONE), 0)).alias("phone"))
    digits = F.length(F.regexp_replace("phone", r"\D", ""))
    return found.select("doc_id", "phone", contact.phone_parts(F.col("phone"))["digits"].alias("digits"), digits.between(7, 15).alias("fits"))


# Urls.

_HOST = "lower(regexp_extract(url, '^(?:https?)://([^/?#]*)', 1))"


@query(f"""SELECT domain, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(h, '(?i){oracle.PLACEHOLDER_DOMAIN}') OR regexp_matches(h, '(?i){oracle.RESERVED_HOST}') OR NOT contains(h, '.') THEN 'public-source' ELSE h END AS domain
  FROM (SELECT regexp_replace({_HOST}, '^www\\.', '') AS h FROM pages)) GROUP BY domain""")
def domain_extract(spark, sf_dir):
    none = F.lit(None).cast("string")
    found = table(spark, sf_dir, "pages").select(urls.safe_domain(none, F.col("url")).alias("domain"))
    return found.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


_CANONICAL = f"""CASE WHEN regexp_matches(h, '(?i){oracle.PLACEHOLDER_DOMAIN}') OR regexp_matches(h, '(?i){oracle.RESERVED_HOST}') THEN NULL ELSE
  scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END END"""
_PAGE_URLS = f"""SELECT page_id, html, {_CANONICAL} AS canonical FROM (
  SELECT page_id, html, {_HOST} AS host, regexp_replace(host, '^www\\.', '') AS h, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
    list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '') AS pairs,
    list_sort(list_filter(list_transform(pairs, lambda p, i: {{'name': split_part(p, '=', 1), 'at': i, 'pair': CASE WHEN contains(p, '=') THEN p ELSE p || '=' END}}), lambda x: NOT regexp_matches(x.name, '(?i){oracle.TRACKING}'))) AS kept,
    array_to_string(list_transform(kept, lambda x: x.pair), '&') AS q FROM pages)"""


@query(f"SELECT page_id, canonical FROM ({_PAGE_URLS})")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.safe_public_url(F.col("url")).alias("canonical"))


@query("""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 0 WHEN page_id % 5 = 0 OR page_id % 2 = 0 THEN 1 ELSE 0 END AS kept, CASE WHEN page_id % 7 <> 0 AND (page_id % 5 = 0 OR page_id % 2 = 0) THEN 'https://www.site' || page_id || '.com/p?a=1' END AS url FROM pages""")
def citation_semi_join(spark, sf_dir):
    """Pages as sources that a response may cite: every 7th cites nothing, so nothing is kept; every other 5th states no
    citations, so all is; of the rest every second cites the source, by another form of its url."""
    k = F.col("page_id")
    site = F.concat(F.lit("https://www.site"), k.cast("string"), F.lit(".com/p"))
    source = F.struct(F.lit("s").alias("id"), F.lit("A page").alias("title"), F.lit(None).cast("string").alias("domain"), F.concat(site, F.lit("?utm_source=z&a=1#top")).alias("url"))
    cited = F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 5 != 0, F.array(F.when(k % 2 == 0, F.concat(site, F.lit("?a=1"))).otherwise(F.lit("https://else.com/"))))
    rows = profiles.settled(table(spark, sf_dir, "pages").select(k, F.array(source).alias("sources"), cited.alias("cited")))
    kept = profiles.settled(rows.select("page_id", profiles.clean_sources(F.col("sources"), F.col("cited")).alias("kept")))
    return kept.select("page_id", F.size("kept").alias("kept"), F.get("kept", 0)["url"].alias("url"))


@query(f"SELECT page_id, h = 'example.com' OR h LIKE '%.example.com' OR h = 'example.org' OR h LIKE '%.example.org' AS approved FROM (SELECT page_id, {_HOST} AS h FROM pages)")
def domain_suffix_match(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", r"^(?:https?)://([^/?#]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", urls.domain_matches(host, ["example.com", "example.org"]).alias("approved"))


@query(f"""SELECT host, page_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY rank, page_id) AS n FROM (
  SELECT {_HOST} AS host, page_id, CASE WHEN url LIKE 'https:%' THEN 0 ELSE 1 END AS rank FROM pages)) WHERE n = 1""")
def dedupe_best_rank(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", r"^(?:https?)://([^/?#]*)", 1))
    pages = table(spark, sf_dir, "pages").select(host.alias("host"), "page_id", F.when(F.col("url").startswith("https:"), 0).otherwise(1).alias("rank"))
    return profiles.dedupe_ranked(pages, ["host"], ["rank", "page_id"])


@query(r"""SELECT page_id, CASE WHEN regexp_matches(title, '(?i)\b(people\s*finder|personal|residential|home address|mobile number|cell phone|social media)\b') THEN 99 ELSE CASE WHEN h = 'example.com' OR h LIKE '%.example.com' THEN 0 ELSE 99 END END AS rank
FROM (SELECT page_id, regexp_extract(html, '(?i)<title>([^<]*)', 1) AS title, lower(regexp_extract(url, '^(?:https?)://([^/?#]*)', 1)) AS h FROM pages)""")
def source_rank(spark, sf_dir):
    """Pages as sources of a provider: official are those of example.com whose title is given a practice's words."""
    pages = table(spark, sf_dir, "pages")
    host = F.lower(F.regexp_extract("url", r"^(?:https?)://([^/?#]*)", 1))
    title = F.regexp_extract("html", r"(?i)<title>([^<]*)", 1)
    mark = F.when((host == "example.com") | host.endswith(".example.com"), " Eastside Clinic").otherwise("")
    source = F.struct(F.concat(title, mark).alias("title"), host.alias("domain"), F.col("url").alias("url"))
    return pages.select("page_id", profiles.source_rank(source, F.lit("Eastside Clinic")).alias("rank"))


# Joins and merges.


@query("""SELECT c_custkey, hint FROM (SELECT c_custkey, CASE WHEN n_regionkey::VARCHAR <> '2' THEN 4 ELSE 0 END + CASE WHEN lower(c_mktsegment) <> 'building' THEN 2 ELSE 0 END + CASE WHEN lower(n_name) <> 'nation_7' THEN 1 ELSE 0 END AS hint
  FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def hint_rank_order(spark, sf_dir):
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.struct(F.col("n_regionkey").cast("string").alias("zip"), F.col("c_mktsegment").alias("city"), F.col("n_name").alias("state"))
    return met.select("c_custkey", profiles.location_hint(place, F.lit("2"), F.lit("Building"), F.lit("NATION_7")).alias("hint"))


@query("""WITH p AS (SELECT c_custkey, lpad((c_custkey // 2)::VARCHAR, 10, '0') AS npi, 'p' || (c_custkey // 3) AS pid, lower(replace(replace(c_name, 'Customer', 'Supplier'), '#', ' ')) AS name FROM customer),
r AS (SELECT s_suppkey AS ordinal, CASE WHEN s_acctbal > 0 THEN lpad(s_suppkey::VARCHAR, 10, '0') ELSE '' END AS npi, 'p' || s_suppkey AS pid, lower(replace(s_name, '#', ' ')) AS name FROM supplier)
SELECT c_custkey, min(ordinal) AS ordinal FROM p JOIN r ON (r.npi = '' OR p.npi = r.npi) AND (p.pid = r.pid OR p.npi = r.npi OR p.name = r.name) GROUP BY c_custkey""")
def first_match_join(spark, sf_dir):
    """Customers as profiles, each with the first supplier, as a request, that it matches."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    people = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lpad(F.floor(k / 2).cast("string"), 10, "0").alias("npi"), F.concat(F.lit("p"), F.floor(k / 3).cast("string")).alias("providerId"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("providerName")
    )
    asked = table(spark, sf_dir, "supplier").select(s.alias("ordinal"), F.when(F.col("s_acctbal") > 0, F.lpad(s.cast("string"), 10, "0")).alias("npi"), F.concat(F.lit("p"), s.cast("string")).alias("providerId"), F.col("s_name").alias("name"))
    return profiles.match_requests(people, asked, "c_custkey").select("c_custkey", "ordinal")


@query("""SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') UNION ALL SELECT doc_id, 9 FROM documents WHERE lang = 'en'""")
def replace_merge(spark, sf_dir):
    new = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.lit(9).alias("quality"))
    return profiles.replace_by_identity(table(spark, sf_dir, "labels").select("doc_id", "quality"), new, ["doc_id"])


@query("SELECT user_id, arg_max(event_type, event_id) AS last_type, min(event_id) AS first_at FROM events GROUP BY user_id")
def last_wins_index(spark, sf_dir):
    """Users meet the last of their events, as observations meet the last version of their case."""
    events = table(spark, sf_dir, "events")
    users = events.groupBy("user_id").agg(F.min("event_id").alias("first_at"))
    met = evaluation.join_cases(users, events.select("user_id", "event_id", F.col("event_type").alias("last_type")), "user_id", "event_id")
    return met.select("user_id", "last_type", "first_at")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_fallback(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("l"))
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("l", F.lit(False)).alias("labelled"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: A label with one u umlaut at its end, in Punycode: the delta of the letter in digits of base 36, whose thresholds are 1, 1, 26.
_HOSTS_SQL = f"""WITH h AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages),
l AS (SELECT *, split_part(host, '.', 1) AS label, substr(host, length(split_part(host, '.', 1)) + 1) AS rest, length(split_part(host, '.', 1)) AS n FROM h),
d AS (SELECT *, 124 * (n + 1) + n AS d FROM l),
q AS (SELECT *, (d - 1) // 35 AS q1, CASE WHEN (d - 1) // 35 >= 1 THEN ((d - 1) // 35 - 1) // 35 END AS q2 FROM d),
c AS (SELECT *, '{_LETTERS}' AS c FROM q)
SELECT page_id, scheme || '://xn--' || label || '-' || substr(c, 2 + (d - 1) % 35, 1) || CASE WHEN q1 < 1 THEN 'a' ELSE substr(c, 2 + (q1 - 1) % 35, 1) || substr(c, q2 + 1, 1) END || rest || '/p' AS shown,
  'xn--' || label || '-' || substr(c, 2 + (d - 1) % 35, 1) || CASE WHEN q1 < 1 THEN 'a' ELSE substr(c, 2 + (q1 - 1) % 35, 1) || substr(c, q2 + 1, 1) END || rest || '/p' AS key FROM c"""


@query(_HOSTS_SQL)
def international_hosts(spark, sf_dir):
    """Pages' hosts with a letter beyond ASCII at the end of their first label, as a browser writes them."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    odd = F.concat(F.regexp_extract("url", "^[a-z]+://", 0), F.regexp_replace(host, r"^([^.]*)", F.concat(F.lit("$1"), F.when(F.col("page_id") % 2 == 0, "Ü").otherwise("u\u0308"))), F.lit("/p"))
    made = profiles.settled(pages.select("page_id", odd.alias("odd")))
    return made.select("page_id", urls.safe_public_url(F.col("odd")).alias("shown"), urls.website_key(F.col("odd")).alias("key"))


# Roll-ups.


def _feedback(spark, sf_dir) -> DataFrame:
    """Events as feedback: errors speak against a fact, the rest for it."""
    bad = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("org"), (F.col("user_id") % 10).cast("string")).alias("broker_org_id"), F.lit("consumer").alias("submitter_class"), F.lit(None).cast("string").alias("provider_npi"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("provider_id"),
        F.lit("profile").alias("fact_type"), F.col("event_type").alias("fact_value"), F.when(bad, "incorrect").otherwise("correct").alias("validation_status"), F.when(bad, "outdated").alias("reason_code"), "ts",
    )


_FEEDBACK_SQL = "SELECT 'org' || (user_id % 10) AS broker_org_id, 'consumer' AS submitter_class, '' AS provider_npi, 'u' || user_id AS provider_id, 'profile' AS fact_type, event_type AS normalized_fact_value, CASE WHEN event_type = 'error' THEN 'incorrect' ELSE 'correct' END AS validation_status, CASE WHEN event_type = 'error' THEN 'outdated' ELSE 'accurate' END AS reason_code, ts::DATE AS feedback_day FROM events"


@query(f"SELECT *, {oracle.key(rollups.FEEDBACK_KEYS)} AS aggregation_key FROM (SELECT {', '.join(rollups.FEEDBACK_KEYS)}, count(*) AS feedback_count FROM ({_FEEDBACK_SQL}) GROUP BY ALL)")
def feedback_rollup(spark, sf_dir):
    return rollups.feedback_rollup(rollups.feedback_rows(_feedback(spark, sf_dir))[0])


@query(f"""SELECT *, {oracle.key(rollups.CONSENSUS_KEYS)} AS aggregation_key FROM (SELECT {', '.join(rollups.CONSENSUS_KEYS)}, count(*) FILTER (WHERE validation_status = 'correct') AS positive_count,
  count(*) FILTER (WHERE validation_status <> 'correct') AS negative_count FROM ({_FEEDBACK_SQL}) GROUP BY {', '.join(rollups.CONSENSUS_KEYS)})""")
def consensus_rollup(spark, sf_dir):
    return rollups.consensus_rollup(rollups.feedback_rows(_feedback(spark, sf_dir))[0])


@query(f"""SELECT *, {oracle.key(rollups.CLICK_KEYS)} AS aggregation_key FROM (SELECT 'org' AS broker_org_id, '' AS provider_npi, 'u' || user_id AS provider_id, '216-' || lpad((user_id % 1000)::VARCHAR, 7, '0') AS normalized_phone, ts::DATE AS click_day, count(*) AS click_count
  FROM events WHERE event_type = 'click' AND NOT {oracle.placeholder("'216-' || lpad((user_id % 1000)::VARCHAR, 7, '0')")} GROUP BY ALL)""")
def click_rollup(spark, sf_dir):
    phone = F.concat(F.lit("216-"), F.lpad((F.col("user_id") % 1000).cast("string"), 7, "0"))
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.lit("org").alias("broker_org_id"), F.lit(None).cast("string").alias("provider_npi"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("provider_id"), phone.alias("phone"), "ts")
    return rollups.click_rollup(rollups.click_rows(clicks))


@query("""SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE s = 'completed') AS completed, count(*) FILTER (WHERE s = 'no_results') AS no_results, count(*) FILTER (WHERE s IN ('failed', 'expired')) AS failed,
  count(*) FILTER (WHERE s NOT IN ('completed', 'no_results', 'failed', 'expired')) AS running, CASE WHEN bool_and(s = 'queued') THEN 'queued' WHEN bool_or(s IN ('queued', 'running')) THEN 'running' ELSE 'completed' END AS job_status
FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS s FROM orders) GROUP BY o_custkey""")
def job_summary(spark, sf_dir):
    s = F.col("o_orderstatus")
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.when(s == "F", "completed").when(s == "O", "queued").otherwise("running").alias("status"))
    return jobs.summarize(orders, "o_custkey")


@query(f"SELECT event_id, {oracle.key(['event_type', 'user_id'])} AS key FROM events")
def agg_key_sha256(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", contact.aggregation_key(F.col("event_type"), F.col("user_id")).alias("key"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 1 AS items FROM events")
def props_extract(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", coerce.strings(v, "k").alias("k"), F.size(coerce.items(v)).alias("items"))


# Usage.

_RATES = {"version": "v1", "input": 2.0, "cached": 0.5, "cache_write": 2.5, "output": 8.0, "search": 10.0}


def _attempts(spark, sf_dir) -> DataFrame:
    """Turns as attempts: lengths stand for tokens."""
    n = F.length("text").cast("long")
    cached = F.floor(n / 4).cast("long")
    zero = F.lit(0).cast("long")
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("attempt_ordinal"), F.col("role").alias("model"), F.lit(True).alias("usagePresent"), n.alias("inputTokens"), cached.alias("cachedInputTokens"), (n - cached).alias("uncachedInputTokens"),
        F.when(F.col("role") == "user", zero).alias("cacheWriteTokens"), F.floor(n / 2).cast("long").alias("outputTokens"), zero.alias("webSearchCalls"),
    )
    return usage.with_costs(turns, _RATES)


_ATTEMPTS_SQL = """SELECT conv_id, turn, role, n, c, round((n - c) * 2.0::DOUBLE / 1e6, 12) + round(c * 0.5::DOUBLE / 1e6, 12) + round(o * 8.0::DOUBLE / 1e6, 12) AS total FROM (
  SELECT conv_id, turn, role, length(text) AS n, length(text) // 4 AS c, length(text) // 2 AS o FROM conversations)"""


@query(f"SELECT conv_id, turn AS attempt_ordinal, round(total, 9) AS total_usd FROM ({_ATTEMPTS_SQL})")
def cost_estimate(spark, sf_dir):
    return _attempts(spark, sf_dir).select("conv_id", "attempt_ordinal", F.round("total_usd", 9).alias("total_usd"))


@query(f"""SELECT conv_id, arg_min(role, turn) AS model, count(*) AS attempts, count(*) - 1 AS retries, sum(n)::BIGINT AS input_tokens, CASE WHEN bool_and(role = 'user') THEN 0 END AS cache_write_tokens, round(sum(total), 9) AS total_usd
FROM ({_ATTEMPTS_SQL}) GROUP BY conv_id""")
def search_summary(spark, sf_dir):
    out = usage.search_summary(_attempts(spark, sf_dir), "conv_id")
    return out.select("conv_id", "model", "attempts", "retries", F.col("inputTokens").alias("input_tokens"), F.col("cacheWriteTokens").alias("cache_write_tokens"), F.round("total_usd", 9).alias("total_usd"))


@query("SELECT lang, CASE WHEN count(*) = count(quality) THEN sum(quality) END::BIGINT AS known, sum(quality)::BIGINT AS some FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def strict_null_sum(spark, sf_dir):
    met = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return met.groupBy("lang").agg(stats.strict_sum(F.col("quality")).alias("known"), F.sum("quality").alias("some"))


@query("SELECT count(*) AS providers, count(*) FILTER (WHERE c_acctbal > 0) AS with_npi, count(*) AS with_provider_id, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS with_location FROM customer")
def request_metadata(spark, sf_dir):
    one = F.lit("1")
    asked = table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") > 0, one).alias("npi"), one.alias("providerId"), F.when(F.col("c_mktsegment") == "BUILDING", one).alias("city"), F.lit("").alias("state"), F.lit(None).cast("string").alias("zip"))
    return usage.request_metadata(asked)


# Evaluation.


def _scores(spark, sf_dir) -> DataFrame:
    """Customers as cases: priorities of finished orders are gold, those of open orders are emitted."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.lit("priority").alias("field"), text.plain_text(F.col("o_orderpriority")).alias("value"), "o_orderstatus", "o_orderkey")
    gold = orders.where("o_orderstatus = 'F'").select("o_custkey", "field", "value", F.lit("confirmed_current").alias("status"), F.lit(True).alias("display_safe"), F.lit(None).cast("string").alias("value_hash"))
    emitted = orders.where("o_orderstatus = 'O'").select("o_custkey", "field", F.col("o_orderkey").alias("ordinal"), "value", (F.col("value") != "5 low").alias("cited"))
    return evaluation.score_fields(orders, gold, emitted, "o_custkey")


_SCORES_SQL = """WITH o AS (SELECT o_custkey, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) AS value, o_orderstatus AS s, o_orderkey FROM orders),
g AS (SELECT o_custkey, count(*) AS gold_count, list(DISTINCT value) AS vals FROM o WHERE s = 'F' GROUP BY o_custkey),
x AS (SELECT o_custkey, 'priority' AS field, coalesce(any_value(gold_count), 0) AS gold_count, count(*) FILTER (WHERE s = 'O') AS emitted, count(*) FILTER (WHERE s = 'O' AND list_contains(vals, value)) AS correct,
  count(DISTINCT value) FILTER (WHERE s = 'O' AND list_contains(vals, value)) AS recovered, coalesce(arg_min(list_contains(coalesce(vals, []), value)::BIGINT, o_orderkey) FILTER (WHERE s = 'O'), 0) AS top_one_correct,
  count(*) FILTER (WHERE s = 'O' AND value <> '5 low') AS citation_present, 0 AS unsafe_disclosures, (coalesce(any_value(gold_count), 0) > 0)::BIGINT AS eligible FROM o LEFT JOIN g USING (o_custkey) GROUP BY o_custkey)"""


@query(f"{_SCORES_SQL} SELECT o_custkey, field, eligible, emitted, correct, gold_count, recovered, top_one_correct, citation_present, unsafe_disclosures FROM x")
def field_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


_RATIOS = {"coverage": ("covered", "eligible"), "emitted_precision": ("correct", "emitted"), "gold_recall": ("recovered", "gold_count"), "top_one_accuracy": ("top_one_correct", "eligible"), "citation_presence": ("citation_present", "emitted")}


@query(f"""{_SCORES_SQL}, t AS (SELECT field, {', '.join(f'sum({c}) AS {c}' for c in evaluation.COUNTERS)}, count(*) FILTER (WHERE eligible > 0 AND emitted > 0) AS covered FROM x GROUP BY field)
SELECT field, {', '.join(oracle.ratio(k, a, b) for k, (a, b) in _RATIOS.items())}, unsafe_disclosures::BIGINT AS unsafe_disclosures FROM t""")
def aggregate_scores(spark, sf_dir):
    return evaluation.aggregate_scores(_scores(spark, sf_dir))


@query(f"""SELECT lang, n, good, good / n::DOUBLE AS share, {oracle.wilson('good', 'n')[0]} AS low, {oracle.wilson('good', 'n')[1]} AS high FROM (SELECT lang, count(*) AS n, sum(quality)::BIGINT AS good FROM documents JOIN labels USING (doc_id) GROUP BY lang)""")
def wilson_by_group(spark, sf_dir):
    met = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))
    w = stats.wilson(F.col("good"), F.col("n"))
    return met.select("lang", "n", "good", stats.ratio(F.col("good"), F.col("n")).alias("share"), w["lower"].alias("low"), w["upper"].alias("high"))


_REPEATS_SQL = f"SELECT conv_id, turn, list_distinct(string_split({oracle.plain('text')}, ' ')) AS facts, role FROM conversations"


@query(f"""WITH r AS ({_REPEATS_SQL}), p AS (SELECT a.conv_id, avg(len(list_intersect(a.facts, b.facts))::DOUBLE / len(list_distinct(a.facts || b.facts))) AS j FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY a.conv_id),
m AS (SELECT conv_id, max(n) / sum(n)::DOUBLE AS share FROM (SELECT conv_id, role, count(*) AS n FROM r GROUP BY conv_id, role) GROUP BY conv_id)
SELECT m.conv_id, coalesce(p.j, 1) AS mean_jaccard, m.share AS top_one_agreement FROM m LEFT JOIN p USING (conv_id)""")
def repeat_variance(spark, sf_dir):
    """Turns of a conversation as repeats of a case; their words are the facts."""
    turns = spread(table(spark, sf_dir, "conversations")).select("conv_id", F.split(text.plain_text(F.col("text")), " ").alias("facts"), F.col("role").alias("top_one"))
    return evaluation.repeat_variance(turns, "conv_id")


@query("SELECT user_id, max(n) / sum(n)::DOUBLE AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def mode_share(spark, sf_dir):
    """The share of a user's most frequent kind of event, as the first facts of repeats are compared."""
    repeats = table(spark, sf_dir, "events").select("user_id", F.array().cast("array<string>").alias("facts"), F.col("event_type").alias("top_one"))
    return evaluation.repeat_variance(repeats, "user_id").select("user_id", F.col("top_one_agreement").alias("share"))


@query("""SELECT user_id, avg(gap)::DOUBLE AS mean_ms, max(gap) AS max_ms FROM (SELECT user_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY user_id""")
def latency_stats(spark, sf_dir):
    """The time from each event to the user's next, as the latency of an observation."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    timed = evaluation.with_latency(table(spark, sf_dir, "events").withColumn("before", before), "before", "ts")
    return timed.groupBy("user_id").agg(F.avg("latency_ms").alias("mean_ms"), F.max("latency_ms").alias("max_ms"))


@query("""SELECT event_id, CASE WHEN ts + to_seconds(CASE WHEN event_type = 'purchase' THEN 1800 ELSE 3600 END) > TIMESTAMP '2024-01-15 00:00:00' THEN event_type ELSE 'expired' END AS status FROM events""")
def ttl_expiry(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    state = events.select("event_id", F.col("event_type").alias("status"), jobs.expires_at(F.col("ts"), F.col("event_type") == "purchase").alias("expiresAt"))
    return jobs.read_jobs(events.select("event_id"), state, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), "event_id")
