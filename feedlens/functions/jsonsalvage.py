"""Salvage one JSON object out of a model answer (J-1 … J-9), as Spark expressions.

Strategies run in the service's order and stop at the first that yields an object:
direct → fenced → open_fence → longest (>2 keys) → first → cleaned → regex → rejected.
Braces are read once per answer, in Python over Arrow batches, and only for answers that the first two
strategies did not solve; the time is linear in the answer, however many objects it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memo import by_name
from .text import strip_ws

# Fixed patterns (must equal the service's)
OPEN_FENCE = r"```(?:json)?\s*(\{[\s\S]*)"
FENCE_MARK = r"```(?:json)?"
TRAILING_COMMA = r",(\s*[}\]])"
CLOSED = r"\}\s*```"

STRATEGIES = ("direct", "fenced", "open_fence", "longest", "first", "cleaned", "regex", "rejected")

_JSON_WS = "[ \t\n\r]*"


def is_json_object(c: Column) -> Column:
    """True iff the whole text is exactly one strict JSON object (surrounding JSON whitespace ok).

    The text is put into an array before its own md5, so the parser must consume all of it: trailing
    text fails, and a text that closes the array early or brings further elements does not leave the
    md5 in second and last place. NaN, Infinity and repeated keys are not strict JSON and are refused.
    """
    mark = F.md5(c)
    wrapped = F.concat(F.lit("["), c, F.lit(',"'), mark, F.lit('"]'))
    return (F.coalesce(c.rlike(f'^{_JSON_WS}\\{{{_JSON_WS}["}}]'), F.lit(False))  # what else is refused unread
            & F.try_parse_json(wrapped).isNotNull()
            & (F.coalesce(F.json_array_length(wrapped), F.lit(0)) == 2)
            & F.coalesce(F.get_json_object(wrapped, "$[1]") == mark, F.lit(False)))


def brace_spans(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last brace of each balanced object at depth 0 (K16: a stray `}` leaves the depth at 0).

    `opens` tells `{` from `}`, brace by brace. The depth is the running sum less its lowest value so far.
    """
    walk = np.cumsum(np.where(opens, 1, -1))
    depth = walk - np.minimum(np.minimum.accumulate(walk), 0) if len(walk) else walk
    before = np.append(0, depth[:-1]) if len(walk) else walk
    ends = np.flatnonzero(~opens & (before == 1))
    return np.flatnonzero(opens & (before == 0))[:len(ends)], ends


def nested_spans(opens: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last brace of each `{...}` that holds no deeper objects than plain `{...}`, left to right.

    Pairs `{` `}` with no brace in between are plain. Of the other braces, a `{` right before a `}` makes an object
    with the plain pairs between them; the plain pairs that are in no such object are objects themselves.
    """
    return zip(*(x.tolist() for x in _nested(opens)))


def _nested(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    plain = np.flatnonzero(opens[:-1] & ~opens[1:])
    other = np.ones(len(opens), bool)
    other[plain] = other[plain + 1] = False
    rest = np.flatnonzero(other)
    at = np.flatnonzero(opens[rest][:-1] & ~opens[rest][1:])
    firsts, lasts = rest[at], rest[at + 1]
    k = np.searchsorted(firsts, plain) - 1  # the last object that starts before the pair
    inside = (k >= 0) & (lasts[np.maximum(k, 0)] > plain) if len(firsts) else np.zeros(len(plain), bool)
    firsts, lasts = np.append(firsts, plain[~inside]), np.append(lasts, plain[~inside] + 1)
    order = np.argsort(firsts)
    return firsts[order], lasts[order]


_MAY_FOLLOW = np.isin(np.arange(256), np.frombuffer(b'"} \t\n\r', np.uint8))


class _Lists:
    """Lists of strings, row by row, kept as bytes and lengths."""

    def __init__(self) -> None:
        self.bytes, self.lengths, self.rows = [], [], []

    def add(self, raw: np.ndarray | None, at: np.ndarray | None, likely: bool) -> None:
        """The balanced objects of one text with braces `at`; `likely`: less those that cannot be JSON by their start."""
        if raw is None:
            self.rows.append(None)
            return
        firsts, lasts = brace_spans(raw[at] == ord("{"))
        a, b = at[firsts], at[lasts] + 1
        if likely:
            good = _MAY_FOLLOW[raw[a + 1]]
            a, b = a[good], b[good]
        edge = np.zeros(len(raw) + 1, np.int8)
        edge[a] += 1
        edge[b] -= 1  # an object may start where another ends
        self.bytes.append(raw[np.cumsum(edge[:-1], dtype=np.int8).view(bool)])
        self.lengths.append(b - a)
        self.rows.append(len(a))

    def array(self) -> pa.ListArray:
        none = [n is None for n in self.rows]
        ends = np.cumsum([0, *(n or 0 for n in self.rows)])
        values = _strings(self.bytes, np.concatenate([*self.lengths, np.zeros(0, np.int64)]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(none, False)), values)


def _strings(parts: list[np.ndarray], lengths: np.ndarray) -> pa.StringArray:
    data = np.concatenate([*parts, np.zeros(0, np.uint8)])
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))


def _longest_nested(raw: np.ndarray, at: np.ndarray) -> bytes | None:
    firsts, lasts = _nested(raw[at] == ord("{"))
    if not len(firsts):
        return None
    chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))  # characters before each byte
    a, b = at[firsts], at[lasts] + 1
    k = int(np.argmax(chars[b] - chars[a]))  # the first of equals
    return raw[a[k]:b[k]].tobytes()


def _scanner(likely: bool):
    """Per row the objects of `text` and of `tail` by depth, and the longest of one nested level in `text`."""
    def braces(value):
        if not value.is_valid:
            return None, None
        raw = np.frombuffer(value.as_buffer(), np.uint8)  # braces are one byte each, whatever surrounds them
        return raw, np.flatnonzero((raw == ord("{")) | (raw == ord("}")))

    def run(text: pa.Array, tail: pa.Array) -> pa.Array:
        objects, fenced, nested = _Lists(), _Lists(), []
        for t, u in zip(text, tail):
            raw, at = braces(t)
            objects.add(raw, at, likely)
            fenced.add(*braces(u), likely)
            nested.append(_longest_nested(raw, at) if raw is not None and len(at) else None)
        return pa.StructArray.from_arrays([objects.array(), fenced.array(), pa.array(nested, pa.binary()).view(pa.string())],
                                          names=["objects", "fenced", "nested"])
    return run


_SCANNED = "struct<objects: array<string>, fenced: array<string>, nested: string>"


def scan(text: Column, tail: Column | None = None, likely: bool = False) -> Column:
    """The braces of an answer, read once: see `_scanner`. Null texts give null.

    With `likely` objects that start with what no JSON object starts with are left out.
    """
    return F.arrow_udf(_scanner(likely), _SCANNED)(text, F.lit(None).cast("string") if tail is None else tail)


def brace_objects(c: Column) -> Column:
    """J-6: substrings whose braces balance, in text order."""
    return scan(c)["objects"]


def _tested(objs: Column) -> Column:
    """Each object with what the choices need, tested once."""
    return F.transform(objs, lambda o, i: F.struct(
        is_json_object(o).alias("ok"), (-F.length(o)).alias("less"), i.alias("i"), o.alias("o")))


def _first(objs: Column) -> Column:
    return F.get(F.filter(objs, lambda x: x["ok"]), 0)["o"]


@by_name
def _stages(content: str) -> list[dict[str, Column]]:
    """Column sets of the salvage stages for one content column (built once per context)."""
    c = F.col(content)
    # the first fence that opens an object; no later one can be closed if it is not
    tail = F.when(F.contains(c, F.lit("```")), F.regexp_extract(c, OPEN_FENCE, 1)).otherwise(F.when(c.isNotNull(), F.lit("")))
    # up to the first brace that a closing fence follows
    upto = F.split("_tail", CLOSED, 2)
    fenced = F.when(F.col("_tail") != "", F.when(F.size(upto) == 2, F.concat(upto[0], F.lit("}")))).otherwise(F.lit(""))
    quick = (F.when(is_json_object(c), F.struct(c.alias("j"), F.lit("direct").alias("s")))
             .when((F.col("_fenced") != "") & is_json_object(F.col("_fenced")),
                   F.struct(F.col("_fenced").alias("j"), F.lit("fenced").alias("s"))))
    unsolved = F.col("_quick").isNull()
    scanned = scan(F.when(unsolved, c), F.when(unsolved & (F.col("_tail") != ""), strip_ws(F.col("_tail"))), likely=True)
    tested = {"_objs": _tested(F.col("_scan.objects")), "_open": _first(_tested(F.col("_scan.fenced")))}
    # equal lengths keep text order, like a stable sort by falling length
    longest = F.array_min(F.transform(
        F.filter("_objs", lambda x: x["ok"] & (F.size(F.json_object_keys(x["o"])) > 2)),
        lambda x: F.struct(x["less"], x["i"], x["o"].alias("o"))))["o"]
    best = {"_longest": F.when(F.col("_open").isNull(), longest), "_first": _first(F.col("_objs"))}
    found = (
        F.when(F.col("_quick").isNotNull(), F.col("_quick"))
        .when(F.col("_open").isNotNull(), F.struct(F.col("_open").alias("j"), F.lit("open_fence").alias("s")))
        .when(F.col("_longest").isNotNull(), F.struct(F.col("_longest").alias("j"), F.lit("longest").alias("s")))
        .when(F.col("_first").isNotNull(), F.struct(F.col("_first").alias("j"), F.lit("first").alias("s"))))
    base = F.when(F.col("_found").isNull(), strip_ws(F.regexp_replace(c, FENCE_MARK, "")))
    cleaned = F.when(F.col("_base").startswith("{") & F.col("_base").endswith("}"),
                     F.regexp_replace(F.regexp_replace("_base", "\n", " "), TRAILING_COMMA, "$1"))
    nested = F.when(F.col("_found").isNull(), F.col("_scan.nested"))
    pick = (
        F.when(F.col("_found").isNotNull(), F.col("_found"))
        .when(F.col("_cleaned").isNotNull() & is_json_object(F.col("_cleaned")),
              F.struct(F.col("_cleaned").alias("j"), F.lit("cleaned").alias("s")))
        .when(F.col("_nested").isNotNull() & is_json_object(F.col("_nested")),
              F.struct(F.col("_nested").alias("j"), F.lit("regex").alias("s")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("j"), F.lit("rejected").alias("s"))))
    return [{"_tail": tail}, {"_fenced": fenced}, {"_quick": quick}, {"_scan": scanned}, tested, best, {"_found": found},
            {"_base": base, "_nested": nested}, {"_cleaned": cleaned}, {"_pick": pick}]


def salvage(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds `json_text` (the selected object) and `strategy` to `df`."""
    out = df
    for stage in _stages(content):
        out = out.withColumns(stage)
    # one row for one: a filter by strategy stays above, else it would run the whole salvage a second time
    return out.select(*df.columns, F.inline(F.array(F.struct(F.col("_pick.j").alias("json_text"), F.col("_pick.s").alias("strategy")))))
