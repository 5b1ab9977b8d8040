"""Parts of the SQL that the queries are held against. Patterns are written out here, apart from the engine's own."""

from __future__ import annotations

# Fixed values, in the syntax of DuckDB.
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
UNSAFE = [
    rf"\b(?:https?://|www\.){NOT_SPACE}+", rf'"url"{SPACE}*:', rf'"annotations"{SPACE}*:', rf'"citation"{SPACE}*:', r"\bquote\b", r"\bmember\b", r"\bclient\b", r"\bpatient\b", r"\bdob\b", rf"\bdate{SPACE}*of{SPACE}*birth\b",
    rf"\bbirth{SPACE}*date\b", r"\bdiagnos\w*\b", r"\bmedication\w*\b", r"\bprescription\w*\b", r"\bssn\b", "@",
]
PLACEHOLDER = [
    r"\b(?:\(?\d{3}\)?\D*)?555\D*\d{4}\b", r"\b555\D*010\D*\d{4}\b", r"\b(?:\(?\d{3}\)?\D*)?123\D*4567\b", r"^string(?: optional)?$", "^unknown$", "^n/a$", r"\bmock\b", r"\bfake\b", r"\bdummy\b", r"\bsample\b", r"\bplaceholder\b", r"\bdemo\b",
    r"\btest\b", r"\blorem *ipsum\b", "loremipsum", "source", "public address unavailable",
]
PLACEHOLDER_DOMAIN = r"^(?:example\.(?:com|org|net)|mock\.local|localhost|local|public-source|(?:.+\.)?test)$"
RESERVED_HOST = r"(?:^|\.)(?:invalid|example|localhost|local|test)$"
TRACKING = "^(?:utm_.+|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|ref|referrer|source|tracking)$"


def quoted(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def squeezed(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, '[\x00-\x1f\x7f]', ' ', 'g'), '{SPACE}+', ' ', 'g'))"


def clean(c: str, most: int | None = None) -> str:
    text = f"nullif({squeezed(c)}, '')"
    return text if most is None else f"left({text}, {most})"


def any_of(c: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {quoted(p)})" for p in patterns) + ")"


def unsafe(c: str) -> str:
    return any_of(c, UNSAFE)


def placeholder(c: str) -> str:
    return any_of(squeezed(c), PLACEHOLDER)


def plain(c: str) -> str:
    """Words of ASCII letters and digits; a Latin letter with marks is its base letter, and ends a word."""
    apart = rf"regexp_replace(coalesce({c}, ''), '([\x{{00C0}}-\x{{024F}}\x{{1E00}}-\x{{1EFF}}])', '\1 ', 'g')"
    return f"trim(regexp_replace(lower(strip_accents({apart})), '[^a-z0-9]+', ' ', 'g'))"


def key(names: list[str]) -> str:
    """Hash of the dimensions as a compact JSON array."""
    return "sha256('[' || " + " || ',' || ".join(f"to_json({k}::VARCHAR)" for k in names) + " || ']')"


def wilson(s: str, n: str) -> tuple[str, str]:
    """Lower and upper end of the 95 % interval."""
    z = "1.959963984540054::DOUBLE"
    p, base = f"({s} / {n}::DOUBLE)", f"(1 + {z} * {z} / {n})"
    mid, spread = f"(({p} + {z} * {z} / (2 * {n})) / {base})", f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n})) / {base})"
    return f"greatest(0, {mid} - {spread})", f"least(1, {mid} + {spread})"


def ratio(name: str, s: str, n: str) -> str:
    """A ratio (null where nothing was counted) and its interval as three columns; zeros where nothing was counted."""
    low, high = wilson(s, n)
    some = f"CASE WHEN {n} > 0 THEN"
    return f"{some} {s} / {n}::DOUBLE END AS {name}, {some} {low} ELSE 0 END AS {name}_low, {some} {high} ELSE 0 END AS {name}_high"
