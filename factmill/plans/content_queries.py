"""Coercion, validation and keys over what the tables hold: names, numbers, addresses, JSON and whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factmill.functions import contact
from factmill.operators import coerce, validation
from factmill.plans.registry import query, table


def _json(**members: Column) -> Column:
    """A JSON object of columns."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in members.items())), {"ignoreNullFields": "true"})


def _list(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def _quoted(c: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(_json(v=c), r'(?s)^\{"v":(.*)\}$', 1)


@query("""SELECT event_id, 0 AS ordinal, event_type AS value, NULL AS source_id, NULL AS source_name FROM events
UNION ALL SELECT event_id, 1, CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END, user_id::VARCHAR, NULL FROM events
UNION ALL SELECT event_id, 2, props, 'public-source', event_type FROM events""")
def event_facts(spark, sf_dir):
    """Events as loose facts: a string, a number in an object with a source, a text two objects deep; what is no fact goes."""
    c = F.col
    number = F.concat(F.lit('{"number": '), c("value").cast("string"), F.lit(', "source": {"id": '), c("user_id").cast("string"), F.lit("}}"))
    deep = _json(value=F.struct(c("props").alias("label")), sourceName=c("event_type"))
    facts = coerce.facts(F.try_parse_json(_list(_quoted(c("event_type")), number, deep, F.lit("true"), F.lit('{"other": 1}'))))
    each = table(spark, sf_dir, "events").select("event_id", F.posexplode(facts).alias("ordinal", "f"))
    return each.select("event_id", "ordinal", c("f.value").alias("value"), c("f.sourceId").alias("source_id"), c("f.sourceName").alias("source_name"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)
SELECT page_id, 0 AS ordinal, host AS id, host AS title, NULL AS domain, url FROM p UNION ALL SELECT page_id, 1, url, url, url, NULL FROM p UNION ALL SELECT page_id, 2, 'public-source', 'Public source', host, NULL FROM p""")
def page_sources(spark, sf_dir):
    """Pages as loose sources: an object with a title, a bare address, a host alone; one without host and url goes."""
    c = F.col
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    found = coerce.sources(F.try_parse_json(_list(_json(title=host, url=c("url")), _quoted(c("url")), _json(hostname=host), _json(id=host, title=host))))
    each = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("ordinal", "s"))
    return each.select("page_id", "ordinal", *(c(f"s.{k}").alias(k) for k in ("id", "title", "domain", "url")))


@query("""WITH p AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, 0 AS ordinal, c_name AS line1, n_name AS city, c_custkey::VARCHAR AS zip, c_mktsegment AS source_id FROM p
UNION ALL SELECT c_custkey, 1, c_name, NULL, NULL, c_mktsegment FROM p UNION ALL SELECT c_custkey, 2, c_name, NULL, NULL, NULL FROM p""")
def customer_places(spark, sf_dir):
    """Customers as loose locations: under other names, inside another object that names the source, and as a bare text."""
    c = F.col
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey"))
    places = _list(_json(street1=c("c_name"), city=c("n_name"), zipCode=c("c_custkey"), sourceId=c("c_mktsegment")), _json(addressLine1=F.struct(c("c_name").alias("text"), c("c_mktsegment").alias("sourceId"))), _quoted(c("c_name")), _json(city=c("n_name")))
    each = met.select("c_custkey", F.posexplode(coerce.locations(F.try_parse_json(places))).alias("ordinal", "x"))
    return each.select("c_custkey", "ordinal", c("x.addressLine1").alias("line1"), c("x.city").alias("city"), c("x.zip").alias("zip"), c("x.sourceId").alias("source_id"))


@query("""SELECT doc_id, text AS body, nullif(trim(text), '') AS message FROM documents""")
def document_responses(spark, sf_dir):
    """Whole texts inside the JSON of an answer between fences, and as the message of a response; both read back."""
    c = F.col
    said = F.concat(F.lit("Here it is:\n```json\n"), _json(text=c("text")), F.lit("\n```"))
    part = F.struct(F.lit("output_text").alias("type"), c("text").alias("text"))
    response = _json(status=F.lit("completed"), output=F.array(F.struct(F.lit("message").alias("type"), F.array(part).alias("content"))))
    body = coerce.text_of(coerce.part(F.try_parse_json(coerce.json_text(said)), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("body"), coerce.response_text(F.try_parse_json(response)).alias("message"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 AND length(c_custkey::VARCHAR) < 10 THEN 'BAD_NPI' WHEN c_mktsegment = 'BUILDING' THEN 'BAD_NAME' WHEN c_nationkey % 3 = 0 THEN 'BAD_STATE' WHEN c_nationkey % 5 = 0 THEN 'BAD_ZIP' END AS error
FROM customer""")
def customer_checks(spark, sf_dir):
    """Customers as requests: an NPI of too few digits, a name of one letter, a state in small letters, a zip of four digits;
    white space around a value is no error."""
    c = F.col
    segment, nation = c("c_mktsegment"), c("c_nationkey")
    npi = F.when(c("c_acctbal") < 0, c("c_custkey").cast("string")).otherwise(F.concat(F.lit(" "), F.lpad(c("c_custkey").cast("string"), 10, "0")))
    name = F.when(segment == "BUILDING", F.left("c_name", F.lit(1))).otherwise(F.concat(c("c_name"), F.lit("\t")))
    state = F.when(nation % 3 == 0, F.lower(F.left(segment, F.lit(2)))).otherwise(F.left(segment, F.lit(2)))
    error = validation.request_error(F.lit(None).cast("string"), npi, name, state, F.right("c_name", F.when(nation % 5 == 0, 4).otherwise(5)))
    return table(spark, sf_dir, "customer").select("c_custkey", error.alias("error"))


@query("""SELECT c_custkey, left(c_nationkey || ':' || CASE WHEN c_acctbal > 5000 THEN 'npi:' || lpad(c_custkey::VARCHAR, 10, '0') WHEN c_acctbal > 0 THEN 'providerId:' || c_mktsegment ELSE 'name:' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) END, 320) AS key,
  sha256(lower(c_mktsegment)) AS scope FROM customer""")
def customer_keys(spark, sf_dir):
    """Customers as providers of a job: the key by NPI, id or name, and the owner's scope."""
    c = F.col
    npi = F.when(c("c_acctbal") > 5000, F.lpad(c("c_custkey").cast("string"), 10, "0"))
    ident = F.when(c("c_acctbal") > 0, c("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", contact.request_key(c("c_nationkey"), npi, ident, c("c_name")).alias("key"), contact.owner_scope(F.concat(F.lit("  "), c("c_mktsegment"), F.lit("\n"))).alias("scope"))
