"""Names, addresses and whatever else the model has removed that no pattern finds.

The model's redacted text is aligned with the note. Common tokens at both ends of a stretch match; inside, tokens
that occur once in both texts, in the same order, are anchors, and the stretches between them are aligned the same
way. A mark whose neighbours on both sides are matched stands for the note's tokens between them: that span was
removed. Where the model has also reworded the text beside a mark, the span cannot be told and none is given.

A span is a `name` or an `address` only where its own or the surrounding words say so, else `other`. Spans that a
pattern (P1) finds are left to it. Null notes and null redacted texts have no spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X

MARK = X.REDACTED
CONFIDENCE = {"name": 0.7, "address": 0.7, "other": 0.5}
_tokens = re.compile(re.escape(MARK) + r"|\w+|[^\w\s]").finditer

#: Words right before or after a span that tell what it is.
BEFORE_NAME = {"mr", "mrs", "ms", "dr", "prof", "name", "named", "contact", "customer", "client", "regards", "sincerely",
               "from", "by", "with", "met", "called", "herr", "frau", "señor", "señora", "monsieur", "madame"}
AFTER_NAME = {"said", "says", "asked", "asks", "called", "wrote", "writes", "told", "reported", "complained", "wants"}
BEFORE_ADDRESS = {"address", "lives", "located", "office", "ship", "deliver", "delivered", "at"}
IN_ADDRESS = {"street", "st", "avenue", "ave", "road", "rd", "lane", "boulevard", "drive", "square", "straße", "strasse",
              "weg", "platz", "rue", "calle", "avenida", "plaza"}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first, whose seconds rise."""
    ends: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        back[k] = at[n - 1] if n else -1
        ends[n:n + 1] = [j]
        at[n:n + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> dict[int, int]:
    """Matched places, from `b` to `a`, rising in both (see the module)."""
    match: dict[int, int] = {}
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            match[j] = i
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            match[m] = k
        if i == k or j == m:
            continue
        times_a, times_b = Counter(a[i:k]), Counter(b[j:m])
        place = {t: p for p, t in enumerate(b[j:m], j) if times_b[t] == 1}
        anchors = _rising([(p, place[t]) for p, t in enumerate(a[i:k], i) if times_a[t] == 1 and t in place])
        last = (i, j)
        for p, q in anchors:
            match[q] = p
            todo.append((last[0], p, last[1], q))
            last = (p + 1, q + 1)
        if anchors:
            todo.append((last[0], k, last[1], m))
    return match


def _kind(words: list[str], before: str, after: str) -> str:
    if any(w in IN_ADDRESS for w in words) or (before in BEFORE_ADDRESS and any(w.isdigit() for w in words)):
        return "address"
    if (before in BEFORE_NAME or after in AFTER_NAME) and all(w.isalpha() or w in ".-'" for w in words):
        return "name"
    return "other"


def removed(note: str | None, redacted: str | None) -> list[dict]:
    """The spans of `note` that stand behind the marks of `redacted`."""
    if not note or not redacted or MARK not in redacted:
        return []
    at = [(m.group(), m.start(), m.end()) for m in _tokens(note)]
    a, b = [t for t, _, _ in at], [m.group() for m in _tokens(redacted)]
    match = align(a, b)
    out, j = [], 0
    while j < len(b):
        if b[j] != MARK or j in match:
            j += 1
            continue
        end = j + 1
        while end < len(b) and b[end] == MARK and end not in match:
            end += 1
        if (j == 0 or j - 1 in match) and (end == len(b) or end in match):
            first, last = (match[j - 1] + 1 if j else 0), (match[end] if end < len(b) else len(a))
            if first < last:
                low = [w.lower() for w in a[first:last]]
                before = next((w.lower() for w in reversed(a[:first]) if w.isalnum()), "")
                after = next((w.lower() for w in a[last:] if w.isalnum()), "")
                kind = _kind(low, before, after)
                start, stop = at[first][1], at[last - 1][2]
                out.append({"pii_type": kind, "value": note[start:stop], "confidence": CONFIDENCE[kind],
                            "location": {"start": start, "end": stop}})
        j = end
    return out


def model_spans(note: Column, redacted: Column) -> Column:
    """array<PII_DETECTION>: what the model removed and no pattern finds."""
    place = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kind = pa.list_(pa.struct([("pii_type", pa.string()), ("value", pa.string()), ("confidence", pa.float64()),
                               ("location", place)]))

    def run(notes: pa.Array, texts: pa.Array, known: pa.Array) -> pa.Array:
        out = []
        for n, t, places in zip(notes, texts, known):
            spans, places = removed(n.as_py(), t.as_py()), places.as_py()
            out.append([s for s in spans if not any(s["location"]["start"] < k["end"] and k["start"] < s["location"]["end"]
                                                    for k in places)] if places else spans)
        return pa.array(out, kind)
    # the patterns are tried once a note, not once a span
    known = F.transform(X.detect_pii(note), lambda k: k["location"])
    return F.arrow_udf(run, f"array<{S.PII_DETECTION.simpleString()}>")(note, redacted, known)


def model_pii_table(df: DataFrame, key: str = "request_id", content: str = "content",
                    redacted: str = "redacted_text") -> DataFrame:
    """P2 exploded: one row per span, like `ingest.pii_table`."""
    # exploded as an expression: of a column Spark would first ask for its size, and so run the alignment twice
    spans = df.select(key, F.explode(model_spans(F.col(content), F.col(redacted))).alias("p"))
    return spans.select(
        key, "p.pii_type", "p.value", "p.confidence", F.col("p.location.start").alias("span_start"),
        F.col("p.location.end").alias("span_end"))
