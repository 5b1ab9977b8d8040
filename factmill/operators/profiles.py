"""Display-safe profiles: sources cleaned, facts resolved to them, ranked, deduplicated and bound to requests.

A profile is one row and its arrays are short, so all of this is expressions over arrays: no shuffle, no explode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.functions.contact import format_location, requested_npi
from factmill.functions.text import clean_public_text, fact_key, identity, let, name_identity, safe_fact, safe_source_id, trimmed
from factmill.functions.urls import FALLBACK, domain_matches, safe_domain, safe_public_url
from factmill.operators import coerce
from factmill.operators.validation import profile_error
from factmill.sources.files import written

# Fixed values.
GOVERNMENT = ["healthcare.gov", "cms.gov", "medicare.gov", "nppes.cms.hhs.gov"]
DIRECTORIES = ["npiprofile.com", "zocdoc.com", "healthgrades.com", "webmd.com", "vitals.com", "doximity.com"]
RATING_SITES = ["zocdoc.com", "healthgrades.com", "webmd.com", "vitals.com"]
BLOCKED = [
    "whitepages.com", "spokeo.com", "beenverified.com", "truthfinder.com", "radaris.com", "fastpeoplesearch.com",
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com",
]
PERSONAL_TITLE = r"(?i)\b(people\s*finder|personal|residential|home address|mobile number|cell phone|social media)\b"
PROFESSIONAL_TITLE = r"(?i)\b(provider directory|hospital|health system|medical center|clinic|practice|official)\b"
NAME_STOP_WORDS = ["the", "and", "for", "doctor", "dr", "md", "do", "provider", "medical", "health"]
UNRANKED = 99


def name_tokens(name: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda t: (F.length(t) >= 3) & ~t.isin(*NAME_STOP_WORDS))


def looks_official(source: Column, name: Column) -> Column:
    """Whether a source's title is professional and names the provider: one token of one, two of more."""

    def named(tokens: Column) -> Column:
        title = F.regexp_replace(F.lower(source["title"]), "[^a-z0-9]+", " ")
        found = let(title, lambda t: F.size(F.filter(tokens, lambda w: F.contains(t, w))))
        return (F.size(tokens) > 0) & (found >= F.least(F.size(tokens), F.lit(2)))

    known = domain_matches(source["domain"], BLOCKED + GOVERNMENT + DIRECTORIES)
    fine = source["url"].isNotNull() & source["title"].rlike(PROFESSIONAL_TITLE) & ~known & let(name_tokens(name), named)
    return F.coalesce(fine, F.lit(False))


def source_rank(source: Column, name: Column) -> Column:
    """Official 0, government 1, directory 2, blocked, personal or unknown 99."""
    return let(source, lambda s: rank_given(s, looks_official(s, name)))


def rank_given(source: Column, official: Column) -> Column:
    """The rank of a source of which it is known whether it looks official."""
    domain = source["domain"]
    out = source.isNull() | domain_matches(domain, BLOCKED) | source["title"].rlike(PERSONAL_TITLE)
    return F.when(out, UNRANKED).when(official, 0).when(domain_matches(domain, GOVERNMENT), 1).when(domain_matches(domain, DIRECTORIES), 2).otherwise(UNRANKED)


def displayable(domain: Column) -> Column:
    """Whether a source's domain is there and public."""
    return F.coalesce((domain != "") & (domain != FALLBACK), F.lit(False))


def clean_sources(sources: Column, cited: Column | None = None) -> Column:
    """Sources with safe id, title, domain and url, and the raw id; without those that have no title or public domain,
    or that are not cited. Of one safe id the last stays, where the first stood."""
    ready = F.transform(
        sources,
        lambda s, i: F.struct(
            trimmed(s["id"]).alias("raw"), safe_source_id(s["id"], F.concat(F.lit("source-"), (i + 1).cast("string"))).alias("id"), safe_fact(s["title"], 255).alias("title"), safe_domain(s["domain"], s["url"]).alias("domain"), s["url"].alias("url"), i.alias("at")
        ),
    )
    ready = F.transform(ready, lambda s: s.withField("url", safe_public_url(s["url"], s["domain"])))
    kept = F.filter(ready, lambda s: s["title"].isNotNull() & displayable(s["domain"]))
    if cited is not None:
        allowed = F.filter(F.transform(cited, lambda u: safe_public_url(u)), lambda u: u.isNotNull())
        supported = lambda urls: F.filter(kept, lambda s: F.coalesce(F.array_contains(urls, s["url"]), F.lit(False)))
        kept = F.when(cited.isNull(), kept).otherwise(let(allowed, supported))
    return kept


def distinct_sources(kept: Column) -> Column:
    firsts = F.filter(kept, lambda s: ~F.exists(kept, lambda o: (o["id"] == s["id"]) & (o["at"] < s["at"])))
    return F.transform(firsts, lambda s: F.try_element_at(F.filter(kept, lambda o: o["id"] == s["id"]), F.lit(-1)))


def find_source(kept: Column, ident: Column) -> Column:
    """The source that a fact's id names: by raw id, last first, else by safe id; null if none."""
    raw = lambda name: F.coalesce(F.try_element_at(F.filter(kept, lambda s: s["raw"] == name), F.lit(-1))["id"], safe_source_id(name, F.lit(FALLBACK)))
    return let(let(trimmed(ident), raw), lambda safe: F.try_element_at(F.filter(kept, lambda s: s["id"] == safe), F.lit(-1)))


def _resolved(facts: Column, kept: Column, make: Callable[[Column, Column], Column], value: str = "value") -> Column:
    """What make gives for each fact and its source; without facts that have no source or whose value is null."""
    made = F.transform(facts, lambda f: let(find_source(kept, f["sourceId"]), lambda s: F.when(s.isNotNull(), make(f, s))))
    return F.filter(made, lambda m: m[value].isNotNull())


#: Order of texts as a reader expects it: the root order of the Unicode collation.
COLLATION = "UNICODE"


def dedupe_sorted(ranked: Column) -> Column:
    """ranked: structs of rank, order, at, key, x. Of each key the least rank, the first of equals; by rank, then key.

    Sorted by key, each one's first is the one without the same key before it; two sorts, so a row of very many facts
    costs little more than a short one for each fact."""
    by_key = F.array_sort(F.transform(ranked, lambda r: F.struct(r["key"].alias("key"), r["rank"].alias("rank"), r["order"].alias("order"), r["at"].alias("at"), r["x"].alias("x"))))
    firsts = lambda a: F.filter(a, lambda r, i: (i == 0) | (F.get(a, i - 1)["key"] != r["key"]))
    kept = F.transform(let(by_key, firsts), lambda r: F.struct(r["rank"].alias("rank"), r["order"].alias("order"), r["at"].alias("at"), r["x"].alias("x")))
    return F.transform(F.array_sort(kept), lambda r: r["x"])


def _ranked(values: Column, key: Callable[[Column], Column], rank: Callable[[Column], Column]) -> Column:
    placed = lambda v, i: let(key(v), lambda k: F.struct(rank(v).alias("rank"), F.collate(k, COLLATION).alias("order"), i.alias("at"), k.alias("key"), v.alias("x")))
    return F.transform(values, placed)


def location_hint(loc: Column, zip_: Column, city: Column, state: Column) -> Column:
    differs = lambda a, b: (b.isNotNull() & (b != "")) & (identity(a) != identity(b))
    other_zip = zip_.isNotNull() & (zip_ != "") & ~loc["zip"].eqNullSafe(zip_)
    return F.when(other_zip, 4).otherwise(0) + F.when(differs(loc["city"], city), 2).otherwise(0) + F.when(differs(loc["state"], state), 1).otherwise(0)


def prioritized(df: DataFrame, rank_of: Callable[[Column], Column], zip_: Column, city: Column, state: Column, shown: Callable[[Column], Column] = lambda s: s) -> DataFrame:
    """Phones, locations, ratings and websites each once and by rank; sources by rank and domain, as shown."""
    columns = df.columns
    df = settled(df.withColumn("_ranked", F.transform("sources", lambda s, i: F.struct(rank_of(s).alias("rank"), F.collate(s["domain"], COLLATION).alias("order"), i.alias("at"), shown(s).alias("x")))))
    rank = lambda f: F.coalesce(F.try_element_at(F.filter("_ranked", lambda r: r["x"]["id"] == f["sourceId"]), F.lit(-1))["rank"], F.lit(UNRANKED))
    place = lambda v: fact_key(format_location(v["addressLine1"], v["addressLine2"], v["city"], v["state"], v["zip"]))
    out = df.withColumns(
        {
            "phoneNumbers": dedupe_sorted(_ranked(F.col("phoneNumbers"), lambda v: fact_key(v["value"]), rank)),
            "locations": dedupe_sorted(_ranked(F.col("locations"), place, lambda v: location_hint(v, zip_, city, state) * 10 + rank(v))),
            "ratings": dedupe_sorted(_ranked(F.col("ratings"), lambda v: F.concat(v["sourceId"], F.lit(":"), fact_key(v["value"])), lambda v: F.lit(0))),
            "websites": dedupe_sorted(_ranked(F.col("websites"), lambda v: F.lower(v["value"]), rank)),
            "sources": F.transform(F.array_sort("_ranked"), lambda r: r["x"]),
        }
    )
    return out.select(*columns)


def settled(df: DataFrame) -> DataFrame:
    """The same rows, each passed once through a generator. Catalyst does not copy expressions across one, so columns
    that later steps use many times are planned and computed once; no row moves."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")


PROFILE = ["providerId", "npi", "providerName", "specialties", "locations", "phoneNumbers", "ratings", "websites", "publicInsuranceMentions", "sources"]


def sanitize(df: DataFrame, typed: Column, keys: list[str], cited: Column | None = None) -> DataFrame:
    """keys of df and, for each row, its profile (a struct as coerce.profile makes it) cleaned, as columns. Facts keep
    only sources of public domains; contact facts only professional ones; profiles without contact facts go."""
    p = settled(df.select(*keys, typed.alias("p"), *([cited.alias("cited")] if cited is not None else [])))
    p = p.withColumn("kept", clean_sources(F.col("p.sources"), F.col("cited") if cited is not None else None)).withColumn("name", F.coalesce(safe_fact(F.col("p.providerName"), 255), F.lit("Provider")))
    p = settled(p)
    judged = lambda s: let(looks_official(s, F.col("name")), lambda o: s.withField("official", o).withField("rank", rank_given(s, o)))
    p = settled(p.withColumn("kept", F.transform("kept", judged)))
    kept, name, none = F.col("kept"), F.col("name"), F.lit(None).cast("string")
    sourced = lambda s: (s["id"].alias("sourceId"), s["title"].alias("sourceName"))
    fact = lambda f, s: F.struct(safe_fact(f["value"]).alias("value"), *sourced(s))
    professional = lambda s: s["rank"] < UNRANKED
    dialled = lambda v, s: F.when(F.length(F.regexp_replace(v, r"\D", "")).between(7, 15) & professional(s), v)
    phone = lambda f, s: F.struct(let(safe_fact(f["value"]), lambda v: dialled(v, s)).alias("value"), *sourced(s))
    place = lambda f, s: F.struct(
        F.when(professional(s), safe_fact(f["addressLine1"], 255)).alias("addressLine1"), safe_fact(f["addressLine2"], 255).alias("addressLine2"), safe_fact(f["city"], 120).alias("city"), clean_public_text(f["state"], 2).alias("state"), clean_public_text(f["zip"], 10).alias("zip"), *sourced(s)
    )
    rating = lambda f, s: F.struct(F.when(domain_matches(s["domain"], RATING_SITES), safe_fact(f["value"], 80)).alias("value"), safe_fact(f["scale"], 80).alias("scale"), *sourced(s))
    shown = lambda f, s: let(safe_public_url(f["value"], s["domain"]), lambda u: F.when((u == s["url"]) & s["official"], u))
    site = lambda f, s: F.struct(shown(f, s).alias("value"), *sourced(s))
    made = p.select(
        *keys, clean_public_text(F.col("p.providerId"), 255).alias("providerId"), clean_public_text(F.col("p.npi"), 10).alias("npi"), name.alias("providerName"),
        F.transform(F.array("p.specialties", "p.publicInsuranceMentions"), lambda facts: _resolved(facts, kept, fact)).alias("plain"), _resolved(F.col("p.locations"), kept, place, "addressLine1").alias("locations"), _resolved(F.col("p.phoneNumbers"), kept, phone).alias("phoneNumbers"),
        _resolved(F.col("p.ratings"), kept, rating).alias("ratings"), _resolved(F.col("p.websites"), kept, site).alias("websites"), "kept",
    )
    made = settled(made).withColumns({"specialties": F.get("plain", 0), "publicInsuranceMentions": F.get("plain", 1)}).select(*keys, *PROFILE[:-1], "kept")
    used = F.array_distinct(F.concat(*(F.transform(c, lambda f: f["sourceId"]) for c in PROFILE[3:9])))
    shown = F.filter(distinct_sources(kept), lambda s: F.array_contains(used, s["id"]))
    made = made.withColumn("sources", shown).drop("kept")
    made = settled(made).where((F.size("phoneNumbers") > 0) | (F.size("locations") > 0) | (F.size("ratings") > 0) | (F.size("websites") > 0))
    return prioritized(made, lambda s: s["rank"], none, none, none, lambda s: s.dropFields("raw", "at", "official", "rank"))


def first_ordinals(asked: DataFrame, scope: list[str]) -> DataFrame:
    """asked: ordinal, rid, rnpi, rname and the columns ``scope``. The least ordinal for each kind of identity and its
    value: among the requests of each NPI ('' for those without), and among all of them (npi null)."""
    named = F.explode(F.filter(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")) for kind, c in (("id", "rid"), ("npi", "rnpi"), ("name", "rname")))), lambda k: k["value"] != ""))
    each = asked.select(*scope, "ordinal", F.col("rnpi").alias("npi"), named.alias("k")).select(*scope, "k.kind", "k.value", "npi", "ordinal")
    by_npi = each.groupBy(*scope, "kind", "value", "npi").agg(F.min("ordinal").alias("ordinal"))
    return by_npi.unionByName(by_npi.groupBy(*scope, "kind", "value").agg(F.min("ordinal").alias("ordinal")).withColumn("npi", F.lit(None).cast("string")))


def match_requests(profiles: DataFrame, requests: DataFrame, key: str, within: list[str] | None = None) -> DataFrame:
    """profiles: ``key`` and profile columns. requests: ordinal, providerId, npi, name (...). Each profile with the
    first request, by ordinal, that it matches: no conflict of NPIs, and equal id, NPI or name. Columns ``within`` (of
    both sides) must agree too, such as the id of a job.

    A profile never meets the requests that it matches, only the least ordinals of its identities: without an NPI those
    of all requests, with one those of requests without and with the same. So it makes five lookups at most, however
    often a name is asked for, and each lookup finds one row at most. The joins are sorted ones: requests grow with the
    profiles, and by the size of a file that is small while packed Spark would send all of them through the driver.
    """
    scope = within or []
    asked = requests.where(F.coalesce("name", "providerId", "npi").isNotNull()).withColumn("rnpi", identity(requested_npi(F.col("npi"), F.col("providerId")))).withColumn("rid", identity(F.col("providerId"))).withColumn("rname", name_identity(F.col("name")))
    held = [f"_w{i}" for i in range(len(scope))]
    index = first_ordinals(asked.select("ordinal", *(F.col(c).alias(w) for c, w in zip(scope, held, strict=True)), "rid", "rnpi", "rname"), held)
    slim = profiles.select(key, *(F.col(c).alias(f"_p{i}") for i, c in enumerate(scope)), identity(F.col("npi")).alias("pnpi"), identity(F.col("providerId")).alias("pid"), name_identity(F.col("providerName")).alias("pname"))
    look = lambda kind, c, npi: F.struct(F.lit(kind).alias("_kind"), F.col(c).alias("_value"), npi.alias("_npi"))
    # With an NPI: requests of that NPI, and those without one. Else all, whatever NPI they have.
    npis = [F.when(F.col("pnpi") != "", F.col("pnpi")), F.when(F.col("pnpi") != "", F.lit(""))]
    looks = F.array_distinct(F.array(*(look(kind, c, n) for kind, c in (("id", "pid"), ("name", "pname")) for n in npis), look("npi", "pnpi", npis[0])))
    tried = slim.select(key, *(f"_p{i}" for i in range(len(scope))), F.explode(F.filter(looks, lambda x: x["_value"] != "")).alias("x")).select(key, *(f"_p{i}" for i in range(len(scope))), "x.*")
    same = [F.col("kind") == F.col("_kind"), F.col("value") == F.col("_value"), F.col("npi").eqNullSafe(F.col("_npi")), *(F.col(f"_p{i}") == F.col(f"_w{i}") for i in range(len(scope)))]
    first = tried.join(index.hint("merge"), same).groupBy(key).agg(F.min("ordinal").alias("ordinal"))
    named = asked.select("ordinal", *scope, F.struct("providerId", F.nullif("rnpi", F.lit("")).alias("npi"), "name", *(c for c in ("city", "state", "zip") if c in requests.columns)).alias("request"))
    return profiles.join(first.hint("merge"), key).join(named.hint("merge"), ["ordinal", *scope])


def bind_requests(matched: DataFrame) -> DataFrame:
    """The request's ids, and its name where the profile has none of its own; ranked with its hints."""
    own = F.col("providerName")
    named = F.when(name_identity(own) == "provider", F.coalesce("request.name", own)).otherwise(own)
    bound = matched.withColumns({"providerId": F.coalesce("request.providerId", "providerId"), "npi": F.coalesce("request.npi", "npi"), "providerName": named})
    hint = lambda c: F.col(f"request.{c}")
    name = F.coalesce(F.nullif(hint("name"), F.lit("")), F.col("providerName"))
    return prioritized(bound, lambda s: source_rank(s, name), hint("zip"), hint("city"), hint("state"))


def replace_by_identity(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """held without the rows whose keys come again in new, and new."""
    return held.join(new.select(*keys), keys, "left_anti").unionByName(new)


def dedupe_ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order of columns, as an aggregation: each task keeps one row a key, so a hot key
    is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_b"))
    return best.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in rest))


def read_responses(raw: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Raw response texts as keys, v: the response as a variant."""
    return settled(raw.select(*keys, F.try_parse_json(column).alias("v")))


def cited_urls(raw: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys and cited: the urls that raw response texts cite, whether they are accepted or not."""
    return settled(read_responses(raw, column, keys).select(*keys, coerce.citations(F.col("v")).alias("cited")))


def judge_responses(raw: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Raw response texts as keys, cited (urls), profiles (typed) and error: why the whole response is refused, null
    where it is accepted. One profile that breaks the schema refuses its response."""
    v = read_responses(raw, column, keys)
    body = settled(v.select(*keys, coerce.is_incomplete(F.col("v")).alias("incomplete"), coerce.citations(F.col("v")).alias("cited"), F.try_parse_json(coerce.json_text(coerce.response_text(F.col("v")))).alias("j")))
    found = settled(body.select(*keys, "cited", "incomplete", F.try_variant_get("j", "$", "array<variant>").alias("whole"), coerce.part(F.col("j"), "profiles").alias("some")))
    empty = F.col("whole").isNull() & ~coerce.truthy(F.col("some"))
    typed = settled(found.select(*keys, "cited", "incomplete", empty.alias("empty"), F.transform(F.coalesce("whole", coerce.items(F.col("some"))), coerce.profile).alias("profiles")))
    bad = F.get(F.filter(F.transform("profiles", profile_error), lambda e: e.isNotNull()), 0)
    return typed.select(*keys, "cited", "profiles", F.when(F.col("incomplete"), "INCOMPLETE_RESPONSE").when(F.col("empty"), "NO_PROFILE_PAYLOAD").otherwise(bad).alias("error"))


def parse_responses(raw: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One row per profile in raw response texts, sanitised; sources must be cited by the response. Refused responses
    give no rows; judge_responses tells why."""
    fine = settled(judge_responses(raw, column, keys)).where("error is null")
    each = fine.select(*keys, "cited", F.posexplode("profiles").alias("profile_ordinal", "profile"))
    return sanitize(each, F.col("profile"), [*keys, "profile_ordinal"], F.col("cited"))


def profiles_for_requests(raw: DataFrame, column: str, key: str, requests: DataFrame) -> DataFrame:
    """raw: ``key``, the id of a job, and a response text. requests: the providers that each job asks for. The profiles
    of a job's responses that match one of its providers, bound to the first that each matches."""
    # Written, as they are read to look their identities up and again to be bound.
    each = written(parse_responses(raw, column, [key]).withColumn("_row", F.struct(key, "profile_ordinal")), "profiles")
    return bind_requests(match_requests(each, requests, "_row", [key])).drop("_row")


def prompt_providers(requests: DataFrame, key: str, identity_only: bool = False) -> DataFrame:
    """Per request the providers that a prompt names, as JSON in order: ids and name, and the place unless only
    identities are asked for. Other columns of a request are never shown. A request has ten providers at most."""
    shown = ["providerId", "npi", "name"] + ([] if identity_only else ["city", "state", "zip"])
    listed = requests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*shown).alias("p")))).alias("l"))
    return listed.select(key, F.to_json(F.transform("l", lambda x: x["p"])).alias("providers"))
