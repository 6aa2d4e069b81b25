"""Alignment of notes with the model's redacted texts: what was removed, where it can be told."""
import random
import re

import pytest

from feedlens.operators import pii_model as M


def spans(note, redacted):
    return [(s["pii_type"], s["value"]) for s in M.removed(note, redacted)]


@pytest.mark.parametrize("note, redacted, want", [
    ("Mr. Jones called about billing", "Mr. [REDACTED] called about billing", [("name", "Jones")]),
    ("Regards, Ana-Maria O'Neil", "Regards, [REDACTED]", [("name", "Ana-Maria O'Neil")]),
    ("Ship it to 5 Rue Cler, Paris please", "Ship it to [REDACTED], Paris please", [("address", "5 Rue Cler")]),
    ("the code is X12 for now", "the code is [REDACTED] for now", [("other", "X12")]),
    ("Zoë met Li and Bo", "[REDACTED] met [REDACTED] and [REDACTED]", [("other", "Zoë"), ("name", "Li"), ("other", "Bo")]),
    ("nothing here", "nothing here", []),
    ("said Kim to all", "she spoke [REDACTED] with everyone", []),          # reworded beside the mark
    ("a literal [REDACTED] stays", "a literal [REDACTED] stays", []),
    ("Eve", "[REDACTED]", [("other", "Eve")]),
    ("call Tom Tim now", "call [REDACTED] [REDACTED] now", [("other", "Tom Tim")]),
    ("kept all", "kept [REDACTED] all", []),                                # the mark stands for nothing
    (None, "x", []), ("x", None, []), ("", "[REDACTED]", [])])
def test_cases(note, redacted, want):
    assert spans(note, redacted) == want


def test_planted_runs_are_found(spark):
    """Random notes with planted runs of tokens that occur nowhere else: each is given back, with its place."""
    rng = random.Random(2)
    rows = []
    for i in range(300):
        words = [rng.choice("the cat sat on a mat and saw it run off".split()) for _ in range(rng.randrange(0, 60))]
        planted = []
        for k in range(rng.randrange(0, 4)):
            at = rng.randrange(len(words) + 1)
            planted.append(f"Q{i}x{k}")
            words.insert(at, planted[-1])
        note = " ".join(words)
        rows.append((i, note, re.sub(r"Q\d+x\d+", M.MARK, note)))
    df = spark.createDataFrame(rows, "request_id long, content string, redacted_text string")
    got = {}
    for r in M.model_pii_table(df).collect():
        got.setdefault(r.request_id, []).append((r.span_start, r.value))
        assert rows[r.request_id][1][r.span_start:r.span_end] == r.value
    for i, note, redacted in rows:
        found = sorted(got.get(i, []))
        back = note
        for start, value in reversed(found):
            back = back[:start] + M.MARK * len(value.split()) + back[start + len(value):]
        want = [m.group() for m in re.finditer(r"Q\d+x\d+", note)]
        # spans hold planted tokens only, and nearly all of them
        assert [t for _, v in found for t in v.split()] == [t for t in want if t in {x for _, v in found for x in v.split()}]
    told = sum(len(v.split()) for x in got.values() for _, v in x)
    assert told >= 0.95 * sum(len(re.findall(r"Q\d+x\d+", n)) for _, n, _ in rows)


def test_patterns_keep_their_spans(spark):
    df = spark.createDataFrame([(1, "write to Max at max@example.com soon", "write to [REDACTED] at [REDACTED] soon")],
                               "request_id long, content string, redacted_text string")
    assert [(r.pii_type, r.value) for r in M.model_pii_table(df).collect()] == [("other", "Max")]


def test_long_notes_in_moderate_time():
    import time
    note = "so it goes on and on " * 20_000 + "call Ann now " + "and so it went " * 20_000
    t0 = time.time()
    assert spans(note, note.replace("Ann", M.MARK)) == [("other", "Ann")]
    assert time.time() - t0 < 20


def test_notes_are_aligned_once(spark):
    df = spark.createDataFrame([("1", "Contact Ada Lovelace said: mail a@b.org now", "Contact [REDACTED] said: mail [REDACTED] now")],
                               "request_id string, content string, redacted_text string")
    spans = M.model_pii_table(df)
    assert [(r.pii_type, r.value) for r in spans.collect()] == [("name", "Ada Lovelace")]  # the address by pattern is left out
    assert spans._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
