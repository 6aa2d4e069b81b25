"""The brace scanner against a character loop and Python's regular expressions; long answers in linear time."""
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.functions import jsonsalvage as J


def plain_objects(text):
    """Balanced objects by a character loop; a stray closing brace leaves the depth at 0."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        if ch == "{":
            start = i if depth == 0 else start
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start:i + 1])
    return out


def plain_nested(text):
    found = re.findall(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", text)
    return max(found, key=len) if found else None


def random_text(rng):
    weights = rng.choice([(3, 3, 2), (5, 4, 1), (4, 5, 1), (1, 1, 6)])
    return "".join(rng.choices(["{", "}", rng.choice(["a", "é", "日", "😀", " \n"])], weights, k=rng.randrange(40)))


def test_scanner_against_plain_python(spark):
    rng = random.Random(4)
    texts = [random_text(rng) for _ in range(3000)] + ["", None, "{", "}", "{}", "}{", "{{}", "{}}", "no braces"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", J.scan(F.col("t"), F.reverse("t")).alias("s")).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.i]
        if t is None:
            assert (r.s.objects, r.s.fenced, r.s.nested) == (None, None, None)
            continue
        back = df.sparkSession and "".join(reversed(t))
        assert r.s.objects == plain_objects(t)
        assert r.s.fenced == plain_objects(back)
        assert r.s.nested == plain_nested(t)


def test_spans_of_nothing():
    firsts, lasts = J.brace_spans(np.zeros(0, bool))
    assert len(firsts) == len(lasts) == 0 and list(J.nested_spans(np.zeros(0, bool))) == []


GOOD = '{"a": 1, "b": 2, "c": 3}'
MANY = "{x} " * 100_000


@pytest.mark.parametrize("content, strategy, json_text", [
    ('{"a": [' + ", ".join(['{"x": 1}'] * 50_000) + "]}", "direct", None),
    ("see ```json\n" + GOOD + "\n``` " + MANY, "fenced", GOOD),
    ("see ```json " + MANY + GOOD, "open_fence", GOOD),
    (MANY + GOOD, "longest", GOOD),
    (MANY + '{"a": 1}', "first", '{"a": 1}'),
    ('{"a": [' + '{"x": 1},' * 50_000 + "]}", "cleaned", None),
    ("{" + MANY + '{"a": 1}', "regex", '{"a": 1}'),
    ("{" + MANY + "}", "rejected", None),
    ("{" * 300_000 + MANY, "rejected", None),
    ("```{" * 100_000, "rejected", None)])
def test_large_answers_take_linear_time(spark, content, strategy, json_text):
    """Every strategy on answers of 100,000 objects; the old pattern ended the JVM at 3,000."""
    df = spark.createDataFrame([(content,)], "content string")
    t0 = time.time()
    r = J.salvage(df).select("json_text", "strategy").first()
    assert r.strategy == strategy
    assert json_text is None or r.json_text == json_text
    assert time.time() - t0 < 60


def test_first_closed_fence_is_taken(spark):
    cases = [('```json\n{"a": 1}\n``` and ```json\n{"b": 2}\n```', "fenced", '{"a": 1}'),
             ('``` {"a": 1} and more ```json {"b": 2} ```', "open_fence", '{"a": 1}'),
             ('```json {"a": {"b": 1} } ```', "fenced", '{"a": {"b": 1} }')]
    df = spark.createDataFrame([(c,) for c, _, _ in cases], "content string")
    got = [(r.strategy, r.json_text) for r in J.salvage(df).select("strategy", "json_text").collect()]
    assert got == [(s, j) for _, s, j in cases]


def test_a_filter_by_strategy_does_not_salvage_twice(spark):
    df = spark.createDataFrame([('{"a": 1} and {"b": 2}',)], "content string")
    plan = J.salvage(df).filter("strategy = 'first'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_objects_that_cannot_be_json_are_left_out_when_asked(spark):
    df = spark.createDataFrame([('{x} { "a": 1}{"b": {}}{}',), (None,), ("é {é} {\n}",)], "t string")
    got = [r.s and r.s.objects for r in df.select(J.scan(F.col("t"), likely=True).alias("s")).collect()]
    assert got == [['{ "a": 1}', '{"b": {}}', "{}"], None, ["{\n}"]]
