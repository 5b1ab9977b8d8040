"""Loose JSON to typed profiles: aliases, scalars or objects, one or many."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from factmill.functions.text import let
from factmill.functions.urls import FALLBACK

#: Where an object keeps its text, in order.
TEXT_KEYS = ("value", "text", "content", "name", "title", "label")


def part(v: Column, key: str) -> Column:
    """A member of an object as a variant, or a member of a member (a.b); null for other kinds."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def is_object(v: Column) -> Column:
    """Asked as a cast to a struct without fields, which looks at no member; a schema would name all of them."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<boolean>").isNotNull()


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, VOID or the type of a scalar. v is best a column or a variable, as it stands here more than once."""
    return F.when(is_object(v), "OBJECT").when(is_array(v), "ARRAY").otherwise(F.coalesce(F.schema_of_variant(v), F.lit("VOID")))


def text_of(v: Column) -> Column:
    """A string; null for other kinds."""
    return let(v, lambda x: F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string")))


# Written as SQL, as it stands in many places of a profile: the text is parsed faster than columns are put together.
_KIND = "coalesce(schema_of_variant({0}), 'VOID')"
_NO_NUMBER = "'^(?:STRING|BOOLEAN|VOID|OBJECT|ARRAY)'"
#: The fewest digits that make a number: the JVM's own text of large and small ones can have more.
_SHORT = "get(filter(transform(sequence(0, 16), p -> format_string(concat('%.', p, 'e'), d)), t -> CAST(t AS DOUBLE) = d), 0)"
_FIXED = "regexp_replace(CAST(CAST(t AS DECIMAL(38,{})) AS STRING), '[.]?0+$', '')"
#: A number as JavaScript writes it: without zeros behind the point, with an exponent from 1e21 and below 1e-6.
_NUMBER = (
    "CASE WHEN NOT contains(CAST(d AS STRING), 'E') THEN regexp_replace(regexp_replace(CAST(d AS STRING), '[.]0$', ''), '^-0$', '0') ELSE get(transform(array("
    f"{_SHORT}), t -> CASE WHEN abs(d) >= 1 AND abs(d) < 1e21D THEN {_FIXED.format(16)} WHEN abs(d) >= 1e-6D AND abs(d) < 1 THEN {_FIXED.format(24)} ELSE regexp_replace(t, 'e([+-])0', 'e$1') END), 0) END"
)
_OBJECT = "try_variant_get({0}, '$', 'struct<>') IS NOT NULL"
#: Strings and numbers as strings; booleans and the rest as null.
_SCALAR = f"CASE WHEN {_KIND} = 'STRING' THEN try_variant_get({{0}}, '$', 'string') WHEN NOT {_KIND} RLIKE {_NO_NUMBER} THEN get(transform(array(try_variant_get({{0}}, '$', 'double')), d -> {_NUMBER}), 0) END"
_TOP = "get(s.stack, 0)"
_INNER = f"filter(get(transform(array(try_variant_get({_TOP}, '$', 'struct<{', '.join(f'{k}: variant' for k in TEXT_KEYS)}>')), o -> array({', '.join(f'o.{k}' for k in TEXT_KEYS)})), 0), m -> m IS NOT NULL)"
_REST = "CASE WHEN size(s.stack) > 1 THEN slice(s.stack, 2, size(s.stack)) ELSE CAST(array() AS ARRAY<VARIANT>) END"
#: Whether a member ends the search: a string that isn't empty, or a number.
_TEXT = f"NOT {_OBJECT.format(_TOP)} AND ({_KIND.format(_TOP)} NOT RLIKE {_NO_NUMBER} OR {_KIND.format(_TOP)} = 'STRING' AND try_variant_get({_TOP}, '$', 'string') <> '')"
#: The first text under TEXT_KEYS, depth first: a stack of members, the next to look at in front. Each object puts six
#: members there at most, so there are as many steps as the value's brackets allow: the search ends by what is left, at
#: whatever depth or width.
_NESTED = (
    f"aggregate(sequence(1, 1 + {len(TEXT_KEYS)} * regexp_count(CAST(v AS STRING), '[{{]')), named_struct('stack', array(v), 'found', CAST(NULL AS VARIANT)), "
    f"(s, i) -> CASE WHEN s.found IS NOT NULL OR size(s.stack) = 0 THEN s WHEN {_TEXT} THEN named_struct('stack', CAST(array() AS ARRAY<VARIANT>), 'found', {_TOP}) ELSE named_struct('stack', concat({_INNER}, {_REST}), 'found', CAST(NULL AS VARIANT)) END).found"
)
_COERCED = f"v -> CASE WHEN v IS NOT NULL THEN get(transform(array(CASE WHEN {_OBJECT.format('v')} THEN {_NESTED} ELSE v END), x -> {_SCALAR.format('x')}), 0) END"


def _texts(options: list[Column]) -> Column:
    """The text of each of the values. One call serves all members of an object, as the expression is long."""
    return F.call_function("transform", F.array(*options), F.expr(_COERCED))


def _first(texts: Column) -> Column:
    """The first that isn't null or empty."""
    return F.get(F.filter(texts, lambda s: s != ""), 0)


def _named(groups: dict[str, list[Column]], body: Callable[[Callable[[str], Column]], Column]) -> Column:
    """body of a function that gives, for the name of a group of values, the first text in it that isn't empty."""
    options = [o for group in groups.values() for o in group]
    ends = dict(zip(groups, accumulate(len(g) for g in groups.values()), strict=True))
    return let(_texts(options), lambda t: body(lambda name: _first(F.slice(t, ends[name] - len(groups[name]) + 1, len(groups[name])))))


def members(v: Column, *keys: str) -> Column:
    """Members of an object as a struct of variants, all read at once; null for other kinds. A key a.b is a member b of
    the struct a."""
    own = dict.fromkeys(k.split(".")[0] for k in keys)
    below = {a: [k.split(".")[1] for k in keys if k.startswith(f"{a}.")] for a in own}
    typed = lambda a: f"struct<{', '.join(f'{b}: variant' for b in below[a])}>" if below[a] else "variant"
    return F.try_variant_get(v, "$", f"struct<{', '.join(f'{a}: {typed(a)}' for a in own)}>")


def _of(m: Column, *keys: str) -> list[Column]:
    return [reduce(lambda c, k: c[k], key.split("."), m) for key in keys]


def coerce_string(v: Column) -> Column:
    """A scalar, or the first text that an object holds under TEXT_KEYS, however deep and among however many members."""
    return F.get(_texts([v]), 0)


def strings(v: Column, *keys: str) -> Column:
    """The first of the members that has a text which isn't empty."""
    return _first(_texts([part(v, k) for k in keys]))


def truthy(v: Column) -> Column:
    """Whether JavaScript takes a value for true: not null, false, zero or an empty string."""
    k = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    scalar = F.when(k == "VOID", False).when(k == "STRING", F.try_variant_get(v, "$", "string") != "").when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).otherwise(F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(True)))
    return F.when(is_object(v) | is_array(v), True).otherwise(F.coalesce(scalar, F.lit(False)))


def items(v: Column) -> Column:
    """An array's elements; one of anything else; none for what JavaScript calls falsy."""
    return let(v, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.when(truthy(x), F.array(x)).otherwise(F.array().cast("array<variant>"))))


def _first_true(options: list[Column]) -> Column:
    """The first of the members that JavaScript takes for true; an empty array counts as such."""
    return F.get(F.filter(F.array(*options), truthy), 0)


#: Where a fact names its source, and that source's title.
SOURCE_ID = ("sourceId", "source_id", "source.id", "source.sourceId")
SOURCE_NAME = ("sourceName", "source_name", "source.title", "source.name", "source.label")


def _bare(v: Column, m: Column) -> list[Column]:
    """A value that is no object (m: its members) for what it is."""
    return [F.when(m.isNull(), v)]


def _each(v: Column, keys: tuple[str, ...], one: Callable[[Column, Column], Column]) -> Column:
    """one of each item and its members."""
    return F.transform(items(v), lambda x: let(members(x, *keys), lambda m: one(x, m)))


def _facts(v: Column, keys: tuple[str, ...], *more: str) -> Column:
    """value, sourceId, sourceName and the members more of all items that have a value."""

    def one(x: Column, m: Column) -> Column:
        groups = {"value": _bare(x, m) + _of(m, *keys), "id": _of(m, *SOURCE_ID), "name": _of(m, *SOURCE_NAME), **{k: _of(m, k) for k in more}}
        return _named(groups, lambda t: F.struct(t("value").alias("value"), F.when(m.isNotNull(), F.coalesce(t("id"), F.lit(FALLBACK))).alias("sourceId"), t("name").alias("sourceName"), *(t(k).alias(k) for k in more)))

    return F.filter(_each(v, keys + SOURCE_ID + SOURCE_NAME + more, one), lambda x: x["value"].isNotNull())


def facts(v: Column) -> Column:
    return _facts(v, ("value", "phone", "number", "phoneNumber", "url", "href", "website", "name", "text"))


def ratings(v: Column) -> Column:
    return _facts(v, ("value", "rating", "score"), "scale")


def locations(v: Column) -> Column:
    lines, second, code = ("addressLine1", "street1", "streetLine1", "street_line_1"), ("addressLine2", "street2", "streetLine2", "street_line_2"), ("zip", "zipCode", "zip_code")

    def one(x: Column, m: Column) -> Column:
        return let(members(F.get(F.filter(F.array(*_of(m, *lines)), is_object), 0), *SOURCE_ID, *SOURCE_NAME), lambda nested: placed(x, m, nested))

    def placed(x: Column, m: Column, nested: Column) -> Column:
        groups = {
            "line1": _bare(x, m) + _of(m, *lines, "address"), "line2": _of(m, *second), "city": _of(m, "city"), "state": _of(m, "state"), "zip": _of(m, *code),
            "id": _of(m, *SOURCE_ID) + _of(nested, *SOURCE_ID), "name": _of(m, *SOURCE_NAME) + _of(nested, *SOURCE_NAME),
        }
        return _named(groups, lambda t: F.struct(
            t("line1").alias("addressLine1"), t("line2").alias("addressLine2"), t("city").alias("city"), t("state").alias("state"), t("zip").alias("zip"), F.when(m.isNotNull(), F.coalesce(t("id"), F.lit(FALLBACK))).alias("sourceId"), t("name").alias("sourceName"),
        ))

    return F.filter(_each(v, lines + ("address",) + second + ("city", "state") + code + SOURCE_ID + SOURCE_NAME, one), lambda x: x["addressLine1"].isNotNull())


def sources(v: Column) -> Column:
    def one(x: Column, m: Column) -> Column:
        bare = _bare(x, m)
        groups = {"id": bare + _of(m, "id", "sourceId", "domain", "title"), "title": bare + _of(m, "title", "name", "label", "domain"), "domain": bare + _of(m, "domain", "hostname"), "url": _of(m, "url", "href")}
        return _named(groups, lambda t: F.struct(F.coalesce(t("id"), F.lit(FALLBACK)).alias("id"), F.coalesce(t("title"), F.lit("Public source")).alias("title"), t("domain").alias("domain"), t("url").alias("url")))

    return F.filter(_each(v, ("id", "sourceId", "domain", "title", "name", "label", "hostname", "url", "href"), one), lambda x: x["domain"].isNotNull() | x["url"].isNotNull())


#: Lists of a profile under their names, in order.
LISTS = {"specialties": ("specialties",), "phoneNumbers": ("phoneNumbers", "phones", "phone_numbers"), "websites": ("websites", "links", "website"), "publicInsuranceMentions": ("publicInsuranceMentions", "insuranceMentions"), "locations": ("locations", "addresses")}


def profile(v: Column) -> Column:
    """One loose profile as a typed struct."""

    def read(m: Column) -> Column:
        # The four lists of plain facts are read by one expression.
        plain = F.array(*(_of(m, *LISTS[c])[0] if len(LISTS[c]) == 1 else _first_true(_of(m, *LISTS[c])) for c in ("specialties", "phoneNumbers", "websites", "publicInsuranceMentions")))
        own = {"id": _of(m, "providerId"), "npi": _of(m, "npi"), "name": _of(m, "providerName", "name")}
        return F.struct(
            _named(own, lambda t: F.struct(t("id").alias("id"), t("npi").alias("npi"), t("name").alias("name"))).alias("own"), F.transform(plain, facts).alias("plain"),
            locations(_first_true(_of(m, *LISTS["locations"]))).alias("locations"), ratings(m["ratings"]).alias("ratings"), sources(m["sources"]).alias("sources"),
        )

    def typed(r: Column) -> Column:
        plain = lambda i: F.get(r["plain"], i)
        return F.struct(
            r["own"]["id"].alias("providerId"), r["own"]["npi"].alias("npi"), F.coalesce(r["own"]["name"], F.lit("Provider")).alias("providerName"),
            plain(0).alias("specialties"), r["locations"].alias("locations"), plain(1).alias("phoneNumbers"),
            r["ratings"].alias("ratings"), plain(2).alias("websites"), plain(3).alias("publicInsuranceMentions"), r["sources"].alias("sources"),
        )

    every = [k for keys in LISTS.values() for k in keys]
    return let(let(members(v, "providerId", "npi", "providerName", "name", *every, "ratings", "sources"), read), typed)


def json_text(c: Column) -> Column:
    """From the first opening to the last closing bracket of a text, which a code fence is not in; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)[\[{].*[\]}]", 0), F.lit(""))


def response_text(v: Column) -> Column:
    """A response's output_text, or the texts of its messages, one a line."""
    messages = F.filter(items(part(v, "output")), lambda o: text_of(part(o, "type")) == "message")
    parts = F.flatten(F.transform(messages, lambda o: F.filter(items(part(o, "content")), lambda p: text_of(part(p, "type")) == "output_text")))
    joined = let(F.trim(F.array_join(F.transform(parts, lambda p: text_of(part(p, "text"))), "\n")), lambda t: F.when(t != "", t))
    return F.coalesce(let(text_of(part(v, "output_text")), lambda t: F.when(F.trim(t) != "", t)), joined)


def is_incomplete(v: Column) -> Column:
    """Whether a response states a status other than completed."""
    return F.coalesce(text_of(part(v, "status")) != "completed", F.lit(False))


def citations(v: Column) -> Column:
    """Urls that a response cites, each once, in order."""
    notes = F.flatten(F.flatten(F.transform(items(part(v, "output")), lambda o: F.transform(items(part(o, "content")), lambda p: items(part(p, "annotations"))))))
    cited = F.filter(notes, lambda a: text_of(part(a, "type")) == "url_citation")
    urls = F.transform(cited, lambda a: F.coalesce(text_of(part(a, "url")), text_of(part(a, "url_citation.url"))))
    return F.array_distinct(F.filter(urls, lambda u: F.coalesce(u != "", F.lit(False))))


def token_count(v: Column) -> Column:
    """A whole number from 0 to 2**53 - 1, else null."""
    number = lambda x: F.when(~kind(x).rlike("^(?:STRING|BOOLEAN|VOID|OBJECT|ARRAY)"), F.try_variant_get(x, "$", "double"))
    return let(let(v, number), lambda n: F.when((n >= 0) & (n <= 2**53 - 1) & (n == F.floor(n)), n.cast("long")))


def usage(v: Column) -> Column:
    """Token counts of a response; what isn't cached only if the cached don't exceed the input."""
    u = part(v, "usage")
    fresh, cached = token_count(part(v, "usage.input_tokens")), token_count(part(v, "usage.input_tokens_details.cached_tokens"))
    searches = F.size(F.filter(items(part(v, "output")), lambda o: text_of(part(o, "type")) == "web_search_call"))
    return F.struct(
        is_object(u).alias("usagePresent"), fresh.alias("inputTokens"), cached.alias("cachedInputTokens"), F.when(cached <= fresh, fresh - cached).alias("uncachedInputTokens"),
        token_count(part(v, "usage.input_tokens_details.cache_write_tokens")).alias("cacheWriteTokens"), token_count(part(v, "usage.output_tokens")).alias("outputTokens"),
        token_count(part(v, "usage.output_tokens_details.reasoning_tokens")).alias("reasoningOutputTokens"), token_count(part(v, "usage.total_tokens")).alias("totalTokens"), searches.cast("long").alias("webSearchCalls"),
    )
