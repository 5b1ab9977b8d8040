"""Public domains and urls, read as browsers read them, hosts beyond ASCII too."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from factmill.functions.text import clean_public_text, contains_unsafe, let

# Fixed values.
FALLBACK = "public-source"
PLACEHOLDER_DOMAIN = r"(?i)^(?:example\.(?:com|org|net)|mock\.local|localhost|local|public-source|(?:.+\.)?test)$"
RESERVED_HOST = r"(?i)(?:^|\.)(?:invalid|example|localhost|local|test)$"
PUBLIC_HOST = r"(?i)^(?=.{1,253}$)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"
TRACKING = r"(?i)^(?:utm_.+|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|ref|referrer|source|tracking)$"

#: Scheme, authority, path and query: any number of slashes of either kind stands before a web address's authority.
WEB = r"(?i)^(https?):[/\\]*([^/?#\\]*)([^?#]*)(?:\?([^#]*))?"
#: Authority of an address of any scheme that has one.
AUTHORITY = r"(?i)^(?:(?:https?|ftp|wss?):[/\\]*|(?!file:)[a-z][a-z0-9+.-]*://)([^/?#\\]*)"
FORBIDDEN_IN_HOST = r"[\x00-\x20\x7f\"#%/:<>?@\[\\\]^`|]"
#: Characters that a path shows as percent codes, and segments that stand for this folder or the one above.
UNSAFE_IN_PATH = r'[^!-~]|["<>`{}]'
#: A lower-cased address of a plain host and path, which is shown as it is written.
PLAIN = r"\Ahttps?://[a-z0-9][a-z0-9.-]*[a-z0-9](?:/[A-Za-z0-9_~-]+)*/?\z"
DOTS = r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)"


#: Letters that browsers keep in a host and the JVM's mapping does not: hosts with them are refused.
KEPT_BY_BROWSERS = "[\u00df\u03c2\u200c\u200d]"


def ascii_host(host: Column) -> Column:
    """A lower-cased host in ASCII: labels with other letters are mapped to their plain forms and written in Punycode, by
    the JVM's own tables (IDNA of 2003, new letters allowed). Null where that can't be.

    Spark takes what it asks the JVM for as not deterministic: it may stand in a column, but not inside an aggregate or a
    join's condition; make it a column first."""
    mapped = F.when(~host.rlike(KEPT_BY_BROWSERS), F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host, F.lit(1))))
    return F.when(host.rlike(r"[^\x00-\x7f]"), mapped).otherwise(host)


def _host(authority: Column) -> Column:
    """Lower-cased host in ASCII without user and port; null where it could be none."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    plain = let(bare, lambda h: F.when(h.contains("%"), F.lower(F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B"))))).otherwise(h))
    return let(let(plain, ascii_host), lambda h: F.when((h != "") & ~h.rlike(FORBIDDEN_IN_HOST), h))


def host_of(url: Column) -> Column:
    """Host of an address of any scheme that has one; null for none."""
    trimmed = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")
    return _host(F.regexp_extract(trimmed, AUTHORITY, 1))


def is_placeholder_domain(c: Column) -> Column:
    return let(F.lower(clean_public_text(c, 255)), lambda d: d.isNull() | d.rlike(PLACEHOLDER_DOMAIN))


def _without_www(d: Column) -> Column:
    return F.when(d.startswith("www."), F.substring(d, F.lit(5), F.length(d))).otherwise(d)


def _public(raw: Column) -> Column:
    """A domain without www. if it is public and safe, else FALLBACK."""
    domain = let(F.lower(clean_public_text(raw, 255)), _without_www)
    fine = lambda d: d.rlike(PUBLIC_HOST) & ~d.rlike(RESERVED_HOST) & ~d.rlike(PLACEHOLDER_DOMAIN) & ~contains_unsafe(d)
    return let(domain, lambda d: F.when(fine(d), d).otherwise(FALLBACK))


def safe_domain(domain: Column, url: Column) -> Column:
    """The public host of the url, else the domain, without www.; FALLBACK where it is neither public nor safe."""
    host = lambda u: F.when(u.rlike(PLAIN), F.regexp_extract(u, AUTHORITY, 1)).otherwise(host_of(u))
    return _public(F.coalesce(let(let(let(url, host), _without_www), lambda h: F.when(h != "", h)), let(domain, lambda d: F.when(d != "", d))))


def _shown_path(path: Column) -> Column:
    """A path from its root, percent codes for what is not plain, without dot segments."""

    def coded(p: Column) -> Column:
        each = F.transform(F.regexp_extract_all(p, F.lit("(?s)."), 0), lambda x: F.when(x == " ", "%20").when(x.rlike(UNSAFE_IN_PATH), F.url_encode(x)).otherwise(x))
        return F.when(p.rlike(UNSAFE_IN_PATH), F.array_join(each, "")).otherwise(p)

    def undotted(p: Column) -> Column:
        plain = lambda s: F.regexp_replace(s, "(?i)%2e", ".")
        none = F.array().cast("array<string>")
        step = lambda acc, s: F.when(plain(s) == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(plain(s) == ".", acc).otherwise(F.array_append(acc, s))
        folded = lambda parts: F.array_append(F.aggregate(parts, none, step), F.lit(""))
        # A dot segment at the end leaves its slash.
        tail = lambda parts: F.when(plain(F.element_at(parts, -1)).isin(".", ".."), folded(parts)).otherwise(F.aggregate(parts, none, step))
        whole = let(F.split(F.substring(p, F.lit(2), F.length(p)), "/"), tail)
        return F.when(p.rlike(DOTS), F.concat(F.lit("/"), F.array_join(whole, "/"))).otherwise(p)

    rooted = let(F.replace(path, F.lit("\\"), F.lit("/")), lambda p: F.when(p == "", "/").otherwise(p))
    return let(let(rooted, coded), undotted)


def _shown_query(query: Column) -> Column:
    """Pairs decoded, those that only track a visitor dropped, the others sorted by the UTF-16 units of their names and
    encoded as a form does."""
    decoded = lambda s: F.try_url_decode(F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25"))
    pair = lambda p: F.struct(decoded(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("name"), decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)", 1)).alias("value"))
    named = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    kept = F.filter(named, lambda x: ~x["name"].rlike(TRACKING))
    placed = F.array_sort(F.transform(kept, lambda x, i: F.struct(F.encode(x["name"], "UTF-16BE").alias("order"), i.alias("at"), x["name"].alias("name"), x["value"].alias("value"))))
    return F.when(query == "", "").otherwise(F.array_join(F.transform(placed, lambda x: F.concat(F.url_encode(x["name"]), F.lit("="), F.url_encode(x["value"]))), "&"))


def _split(url: Column) -> Column:
    fields = ("scheme", "authority", "path", "query")
    return let(url, lambda u: F.when(u.rlike(WEB), F.struct(*(F.regexp_extract(u, WEB, i).alias(name) for i, name in enumerate(fields, 1)))))


def safe_public_url(c: Column, expected: Column | None = None) -> Column:
    """An http(s) url of a public host without credentials, tracking parameters and fragment, the others sorted by
    name; null where it isn't one, or its host is unrelated to the expected domain."""

    def public(h: Column) -> Column:
        fine = h != FALLBACK
        if expected is not None:
            fine = fine & (expected.isNull() | (expected == "") | (h == expected) | h.endswith(F.concat(F.lit("."), expected)) | expected.endswith(F.concat(F.lit("."), h)))
        return fine

    def whole(u: Column, shown: Column) -> Column:
        scheme, port = F.lower(u["scheme"]), F.regexp_extract(u["authority"], r":(\d*)$", 1)
        user = F.regexp_extract(u["authority"], "(?s)^(.*)@", 1)
        number = F.coalesce(F.when(port != "", port).cast("long"), F.lit(-1))
        standard = F.when(scheme == "http", 80).otherwise(443)
        shown_port = F.when((number == -1) | (number == standard), "").otherwise(F.concat(F.lit(":"), number.cast("string")))
        query = let(_shown_query(u["query"]), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        fine = user.isin("", ":") & ((port == "") | F.coalesce(port.cast("long") <= 65535, F.lit(False)))
        return F.when(fine, F.concat(scheme, F.lit("://"), shown, shown_port, _shown_path(u["path"]), query))

    def built(x: Column) -> Column:
        plain = F.when(F.endswith(x["text"], F.lit("/")) | (F.length(x["text"]) > F.length(x["host"]) + F.instr(x["text"], "//") + 1), x["text"]).otherwise(F.concat(x["text"], F.lit("/")))
        return F.when(public(x["public"]), F.when(x["parts"].isNull(), plain).otherwise(whole(x["parts"], x["host"])))

    def hosted(x: Column) -> Column:
        host = F.when(x["parts"].isNull(), F.regexp_extract(x["text"], AUTHORITY, 1)).otherwise(_host(x["parts"]["authority"]))
        return let(let(host, lambda h: F.struct(x["text"].alias("text"), x["parts"].alias("parts"), h.alias("host"), _public(h).alias("public"))), built)

    # parts: null where the address is plain.
    split = lambda t: F.struct(t.alias("text"), F.when(~t.rlike(PLAIN), _split(t)).alias("parts"), (t.rlike(PLAIN) | t.rlike(WEB)).alias("web"))
    return let(let(clean_public_text(c, 2048), split), lambda x: F.when(x["web"], hosted(x)))


def website_key(c: Column) -> Column:
    """Host without www. and path without slashes at its end, lower-cased, then the query; null for no safe url."""

    def key(u: Column) -> Column:
        path = F.regexp_replace(F.lower(u["path"]), "/+$", "")
        query = F.when(u["query"] == "", "").otherwise(F.concat(F.lit("?"), u["query"]))
        return F.concat(let(_host(u["authority"]), _without_www), F.when(path == "", "/").otherwise(path), query)

    return let(_split(safe_public_url(c)), key)


def domain_matches(domain: Column, approved: list[str]) -> Column:
    """Whether a domain is one of the approved or below one."""
    return domain.rlike(rf"(?:^|\.)(?:{'|'.join(map(re.escape, approved))})\z")
