"""Cleaning of public text, and what is unsafe or a placeholder."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. White space as JavaScript's \s has it, control characters, and patterns of unsafe or made-up content.
SPACES = r"\t\n\x0B\f\r    -     　﻿"
CONTROLS = r"\x00-\x1f\x7f"
UNSAFE_WORDS = ["quote", "member", "client", "patient", "dob", r"date\s*of\s*birth", r"birth\s*date", r"diagnos\w*", r"medication\w*", r"prescription\w*", "ssn"]
PLACEHOLDER_WORDS = ["mock", "fake", "dummy", "sample", "placeholder", "demo", "test", r"lorem\s*ipsum"]
PLACEHOLDER_ANYWHERE = ["loremipsum", "source", "public address unavailable"]
PLACEHOLDER_WHOLE = r"(?i)^(?:string(?:\s+optional)?|unknown|n/a)$"

#: Java's own word boundary counts letters beyond ASCII as letters; these two do not. Each is cheaper than a boundary.
BEGIN, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
SPACE = f"[{SPACES}]"
URL = rf"(?=[hwHW])(?i){BEGIN}(?:https?://|www\.)[^{SPACES}]"
CITATION = rf'(?i)"(?:url|annotations|citation)"{SPACE}*:'
#: A word that may go on ends anywhere.
_UNSAFE = "|".join(w.removesuffix(r"\w*") if w.endswith(r"\w*") else w.replace(r"\s", SPACE) + END for w in UNSAFE_WORDS)
UNSAFE = f"(?=[qmcpdbsQMCPDBS]){BEGIN}(?i:{_UNSAFE})"
_WORDS = "|".join(w.replace(r"\s", SPACE) for w in PLACEHOLDER_WORDS)
PLACEHOLDER = f"(?=[mfdsptlMFDSPTL])(?i:{BEGIN}(?:{_WORDS}){END}|(?:{'|'.join(PLACEHOLDER_ANYWHERE)}))"
#: What is no digit ends at the next digit, so nothing is tried twice.
PLACEHOLDER_PHONE = rf"{BEGIN}(?:\d{{3}}\D*+)?(?:555\D*+\d{{4}}|123\D*+4567){END}|{BEGIN}555\D*+010\D*+\d{{4}}{END}"
#: White space and control characters that are not one space alone.
_LOOSE = rf"[{SPACES}{CONTROLS}&&[^ ]][{SPACES}{CONTROLS}]*+| [{SPACES}{CONTROLS}]++"

#: What may not stand in a text that is clean as it is, and what else may not in one that is surely safe: each unsafe or
#: made-up word by its beginning, wherever it stands, by first letters.
LOOSE = r"[^ -~]|  |\A | \z"
_SUSPECT_WORDS = {"b": "irth", "c": "lient", "d": "ob|ate|iagnos|ummy|emo", "f": "ake", "l": "orem", "m": "ember|edication|ock", "n": "/a", "p": "atient|rescription|laceholder|ublic", "q": "uote", "s": "sn|ample|ource|tring", "t": "est", "u": "nknown", "w": r"ww\."}
SUSPECT = LOOSE + r"""|[@"]|://|555|123|""" + "|".join(f"[{a}{a.upper()}](?i:{rest})" for a, rest in _SUSPECT_WORDS.items())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it: Catalyst would copy a column into each of
    its uses, but not into the body of a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


#: Characters that are two UTF-16 units, as a raw string of SQL. What is built of it stands in many places, so it is
#: written as SQL, which is parsed faster than columns are put together.
_PAIRED = r"r'[\x{10000}-\x{10FFFF}]'"


def left_units(c: Column, most: int) -> Column:
    """The first ``most`` UTF-16 units of a text, as JavaScript cuts. A character cut in half becomes U+FFFD, as in any
    text that is written in UTF-8."""
    whole = lambda n: f"decode(substring(u, 1, {n}), 'UTF-16BE')"
    half = f"CASE WHEN hex(substring(u, {2 * most - 1}, 1)) BETWEEN 'D8' AND 'DB' THEN concat({whole(2 * most - 2)}, '\ufffd') ELSE {whole(2 * most)} END"
    cut = F.expr(f"t -> CASE WHEN octet_length(t) <= {most} THEN t WHEN t RLIKE {_PAIRED} THEN get(transform(array(encode(t, 'UTF-16BE')), u -> {half}), 0) ELSE left(t, {most}) END")
    return F.get(F.call_function("transform", F.array(c), cut), 0)


def units(c: Column) -> Column:
    """Length in UTF-16 units."""
    counted = F.expr(f"t -> CASE WHEN t RLIKE {_PAIRED} THEN CAST(octet_length(encode(t, 'UTF-16BE')) / 2 AS INT) ELSE length(t) END")
    return F.get(F.call_function("transform", F.array(c), counted), 0)


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def squeeze(c: Column) -> Column:
    """Control characters and runs of white space become one space; none at the ends. Plain ASCII without two spaces side
    by side, as most texts are, is told by a cheaper look."""
    loose = lambda t: F.when(t.contains("  ") | t.rlike("[^ -~]"), F.regexp_replace(t, _LOOSE, " ")).otherwise(t)
    return F.trim(let(c, loose))


def clean_public_text(c: Column, most: int | None) -> Column:
    """Squeezed text cut to ``most`` UTF-16 units (None: whole), not trimmed again; null for nothing."""
    if most is None:
        return _cleaned(c, None)
    fine = lambda t: (t != "") & (F.octet_length(t) <= most) & ~t.rlike(LOOSE)
    return let(c, lambda t: F.when(fine(t), t).otherwise(_cleaned(t, most)))


def _cleaned(c: Column, most: int | None) -> Column:
    text = let(squeeze(c), lambda t: F.when(t != "", t))
    return text if most is None else left_units(text, most)


def contains_unsafe(c: Column) -> Column:
    return any_of(c.contains("@"), c.rlike(UNSAFE), (c.contains("://") | c.contains(".")) & c.rlike(URL), c.contains('"') & c.rlike(CITATION))


def _made_up(squeezed: Column) -> Column:
    phone = (squeezed.contains("555") | squeezed.contains("123")) & squeezed.rlike(PLACEHOLDER_PHONE)
    return any_of(squeezed.rlike(PLACEHOLDER_WHOLE), squeezed.rlike(PLACEHOLDER), phone)


def contains_placeholder(c: Column) -> Column:
    return let(squeeze(c), _made_up)


def is_safe(cleaned: Column) -> Column:
    """Whether a cleaned text is there and holds nothing unsafe or made up."""
    return cleaned.isNotNull() & ~contains_unsafe(cleaned) & ~_made_up(cleaned)


def safe_fact(c: Column, most: int | None = 500) -> Column:
    """Clean text, null where it is unsafe or a placeholder. Most texts hold nothing suspect, which one look tells."""
    judged = lambda t: let(_cleaned(t, most), lambda x: F.when(is_safe(x), x))
    short = lambda t: F.lit(True) if most is None else F.octet_length(t) <= most
    return let(c, lambda t: F.when((t != "") & short(t) & ~t.rlike(SUSPECT), t).otherwise(judged(t)))


def safe_phone(c: Column) -> Column:
    """value (null if refused) and reason."""

    def judged(text: Column) -> Column:
        kept = F.regexp_replace(text, r"[^\d+(). -]", "")
        few = ~F.length(F.regexp_replace(text, r"\D", "")).between(7, 15)
        reason = F.when(~is_safe(text), "UNSAFE_PHONE_VALUE").when(few, "INVALID_PHONE_VALUE")
        return let(reason, lambda r: F.struct(F.when(r.isNull(), F.trim(kept)).alias("value"), r.alias("reason")))

    return let(clean_public_text(c, 30), judged)


def safe_source_id(c: Column, fallback: Column) -> Column:
    plain = lambda t: F.when(t.contains("--") | t.rlike("[^a-zA-Z0-9_.:-]"), F.regexp_replace(F.regexp_replace(t, r"[^a-zA-Z0-9_.:-]", "-"), "-+", "-")).otherwise(t)
    # What is cleaned is never empty, nor is what it becomes.
    return F.coalesce(let(clean_public_text(c, 80), plain), fallback)


def fact_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def trimmed(c: Column) -> Column:
    """Without white space at the ends; where a sign of ASCII stands at both, there is none."""
    ends = lambda t: F.ascii(t).between(33, 126) & F.ascii(F.right(t, F.lit(1))).between(33, 126)
    return let(c, lambda t: F.when(ends(t), t).otherwise(F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", "")))


def identity(c: Column) -> Column:
    return F.lower(trimmed(F.coalesce(c, F.lit(""))))


def name_identity(c: Column) -> Column:
    return F.trim(F.regexp_replace(identity(c), "[^a-z0-9]+", " "))


@lru_cache(maxsize=1)
def _decomposed() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Characters beyond ASCII whose compatibility decomposition (NFKD) holds letters or digits of ASCII, with what they
    become: one alone, one with marks behind it, several. Built from Python's own tables; planes above the second hold
    none."""
    alone, marked, several = {}, {}, {}
    for code in range(0x80, 0x20000):
        c = chr(code)
        d = unicodedata.normalize("NFKD", c)
        if d != c and any(x.isascii() and x.isalnum() for x in d):
            plain = "".join(x if x.isascii() and x.isalnum() else " " for x in d)
            (alone if len(plain) == 1 else marked if not plain[1:].strip() and plain[0] != " " else several)[c] = plain
    return alone, marked, several


def _one_of(found: dict[str, str]) -> str:
    """A pattern of one of many characters beyond ASCII: ranges, tried on no ASCII character, as Java tries the members of
    a class one after another."""
    codes = sorted(map(ord, found))
    starts = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return r"(?![\x00-\x7f])[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]"


def plain_text(c: Column) -> Column:
    """Lower-cased words of ASCII letters and digits, after compatibility decomposition: an accented letter is its base
    letter followed by a mark, which ends a word, as any other sign does."""
    alone, marked, several = _decomposed()
    short = F.from_json(F.lit(json.dumps(several)), "map<string, string>")  # a constant, folded once

    def folded(t: Column) -> Column:
        spelt = F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(?s)."), 0), lambda x: F.coalesce(F.when(x > "\x7f", short[x]), x)), "")
        spaced = F.regexp_replace(let(t, lambda u: F.when(u.rlike(_one_of(several)), spelt).otherwise(u)), f"({_one_of(marked)})", "$1 ")
        return F.translate(spaced, "".join([*alone, *marked]), "".join([*alone.values(), *(v[0] for v in marked.values())]))

    ascii_ = let(F.coalesce(c, F.lit("")), lambda t: F.when(t.rlike(r"[^\x00-\x7f]"), folded(t)).otherwise(t))
    return F.trim(F.regexp_replace(F.lower(ascii_), "[^a-z0-9]+", " "))
