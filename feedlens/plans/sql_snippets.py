"""DuckDB SQL snippets shared by oracle statements (PII, whitespace, Luhn)."""

from __future__ import annotations

from ..functions.text import PII_PATTERNS

# same Unicode whitespace class as functions.text.WS (RE2 syntax)
WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def word_count(expr: str) -> str:
    s = strip(expr)
    return f"CASE WHEN {s} = '' THEN 0 ELSE len(string_split_regex({s}, '{WS}+')) END"


def luhn(digits: str) -> str:
    d = f"reverse({digits})"
    x = f"CAST(substr({d}, i + 1, 1) AS INTEGER)"
    return (f"(list_sum(list_transform(range(length({digits})), lambda i: "
            f"CASE WHEN i % 2 = 1 THEN CASE WHEN {x} * 2 > 9 THEN {x} * 2 - 9 ELSE {x} * 2 END "
            f"ELSE {x} END)) % 10 = 0)")


def _sq(s: str) -> str:
    return s.replace("'", "''")


def pii_rows(src: str, key: str = "request_id", content: str = "content") -> str:
    """One row per detection: key, pii_type, value, confidence, span_start, span_end."""
    parts = []
    for name, pattern, conf in PII_PATTERNS:
        p = _sq(pattern)
        parts.append(
            f"SELECT {key}, '{name}' AS pii_type, CAST({conf} AS DOUBLE) AS confidence, "
            f"regexp_extract_all({content}, '{p}') AS ms, string_split_regex({content}, '{p}') AS segs "
            f"FROM {src}")
    union = "\nUNION ALL\n".join(parts)
    return f"""
SELECT {key}, pii_type, value, confidence, span_start, span_start + length(value) AS span_end
FROM (
  SELECT {key}, pii_type, confidence, ms[i] AS value,
         length(array_to_string(segs[1:i], '')) + length(array_to_string(ms[1:i - 1], '')) AS span_start
  FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM ({union}) WHERE len(ms) > 0)
) WHERE pii_type <> 'credit_card' OR {luhn("regexp_replace(value, '[^0-9]', '', 'g')")}"""


def redact(expr: str) -> str:
    out = expr
    for _, pattern, _ in PII_PATTERNS:
        out = f"regexp_replace({out}, '{_sq(pattern)}', '[REDACTED]', 'g')"
    return out


#: Same as functions.exact.billed_cost (K8).
BILLED = "CASE WHEN from_cache THEN 0.0 ELSE cost_usd END"


def xsum(expr: str) -> str:
    """Same as functions.exact.xsum."""
    return f"CAST(sum(CAST({expr} AS DECIMAL(38,10))) AS DOUBLE)"


def xavg(expr: str) -> str:
    return f"({xsum(expr)} / CAST(count({expr}) AS DOUBLE))"


def rsum(expr: str, digits: int = 6) -> str:
    """Same as functions.exact.rsum (DuckDB rounds decimals half away from zero = HALF_UP here)."""
    return f"CAST(round(sum(CAST({expr} AS DECIMAL(38,10))), {digits}) AS DOUBLE)"
