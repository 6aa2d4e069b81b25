"""Text expressions: Unicode strip (N1), word count (N2), language (N3), PII.

Everything is a built-in Spark expression so it stays JVM-side in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

# Unicode White_Space, spelled out so Java and RE2 agree (Java's `\s` is ASCII-only and RE2's
# `\s` lacks \v).
WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# the same set as single characters, for trim/translate (no regex on the hot path)
WS_CHARS = ("\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")
REDACTED = "[REDACTED]"

# Fixed PII patterns (ours; common subset of Java regex and RE2, no lookaround), in
# redaction order: ssn, credit_card, email, phone.
PII_PATTERNS = [
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.9),
    ("credit_card", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", 0.9),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.95),
    ("phone", r"\+?1?[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}", 0.8),
]


# Java-only forms with the same matches, cheaper per position: the email can only start where a
# run of local-part characters starts (or where the previous match ended, \G); the phone's first
# character is checked by a one-character lookahead before the optional prefix chain is tried.
JAVA_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?=[-+1 .(0-9])\+?1?[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}",
}


def java_pattern(name: str, pattern: str) -> str:
    return JAVA_PATTERNS.get(name, pattern)


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` – a set-based trim of both ends, no regex scan."""
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return strip_ws(c) == ""


def word_count(c: Column) -> Column:
    """``len(s.split())``; `split` of '' would give one element, so guard it.

    Every Unicode space is first mapped to ' ' with `translate` (a per-character table), so the
    split runs on the cheap single-character pattern.
    """
    s = F.trim(F.translate(c, WS_CHARS, " " * len(WS_CHARS)))
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, " +")))


def language(code: Column) -> Column:
    """Keep en/es/fr/de, anything else becomes 'other'."""
    lc = F.lower(strip_ws(code))
    return F.when(lc.isin(*S.LANGUAGES[:-1]), lc).otherwise(F.lit("other"))


# a literal each pattern's matches must contain; texts without it skip the regex
PII_GUARD = {"email": "@"}


def _guarded(text: Column, name: str, when_present: Column, otherwise: Column) -> Column:
    g = PII_GUARD.get(name)
    return when_present if g is None else F.when(F.instr(text, g) > 0, when_present).otherwise(otherwise)


SPAN_ARRAY = "array<struct<value:string,start:int,end:int>>"


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<value, start, end>> of all matches, 0-based start, exclusive end.

    One fold over (segment before the match, match) pairs carries the running offset; the lambda
    touches only its own arguments, so the regex split is evaluated once per row.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    segs = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(segs, 1, F.size(matches)).alias("seg"), matches.alias("m"))
    init = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN_ARRAY).alias("out"))

    def step(acc, x):
        start = acc["pos"] + F.length(x["seg"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(
            x["m"].alias("value"), start.alias("start"), end.alias("end")))).alias("out"))

    # only texts with a match pay for the split and the fold
    return F.when(F.size(matches) == 0, F.array().cast(SPAN_ARRAY)) \
        .otherwise(F.aggregate(pairs, init, step, lambda acc: acc["out"]))


def _tagger(name: str, conf: float):
    return lambda s: F.struct(
        F.lit(name).alias("pii_type"), s["value"].alias("value"), F.lit(conf).alias("confidence"),
        F.struct(s["start"].alias("start"), s["end"].alias("end")).alias("location"))


def detect_pii(text: Column) -> Column:
    """array<PII_DETECTION>; card numbers must pass the Luhn check."""
    parts = []
    for name, pattern, conf in PII_PATTERNS:
        spans = _guarded(text, name, _spans(text, java_pattern(name, pattern)),
                         F.array().cast(SPAN_ARRAY))
        if name == "credit_card":
            spans = F.filter(spans, lambda s: F.call_function("luhn_check", F.regexp_replace(s["value"], "[^0-9]", "")))
        parts.append(F.transform(spans, _tagger(name, conf)))
    return F.when(text.isNull(), F.array().cast(T.ArrayType(S.PII_DETECTION))).otherwise(F.concat(*parts))


def redact(text: Column) -> Column:
    """Replace every pattern with [REDACTED], in the fixed order."""
    out = text
    for name, pattern, _ in PII_PATTERNS:
        out = _guarded(out, name, F.regexp_replace(out, java_pattern(name, pattern), REDACTED), out)
    return out
