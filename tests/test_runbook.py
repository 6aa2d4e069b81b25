"""End-to-end workflow job with a test double for the model (answers depend on the prompt row)."""

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedlens.operators import cache as H
from feedlens.operators import ingest as I
from feedlens.plans.runbook import run_workflow
from feedlens.sources import fixtures as FX
from feedlens.streaming.jobs import scratch

ANSWERS = {
    "ingest": json.dumps({"language": "en", "pii_detected": False, "redacted_text": "clean", "word_count": 3}),
    "extract": "Here you go:\n```json\n" + json.dumps({
        "problem_statement": "slow reports", "desired_outcome": "fast reports", "pain_points": ["manual"],
        "value_drivers": ["time"], "confidence_score": 0.8}) + "\n```",
    "self_check": json.dumps({"verifications": [], "overall_accuracy": 0.9, "hallucination_risk": 0.1, "approved": True}),
    "rewrite": json.dumps({"headline": "Faster reports", "problem": "p", "solution": "s",
                           "differentiation": "d", "call_to_action": "c", "key_talking_points": ["a"]}),
}


def answered(batch: pd.DataFrame, answer) -> pd.DataFrame:
    out = batch[["run_id", "step", "provider", "model"]].copy()
    got = [answer(r) for r in batch.itertuples()]
    out["content"] = [c for c, _ in got]
    out["error"] = [e for _, e in got]
    out["tokens_input"] = batch["prompt"].str.len() // 4
    out["tokens_output"] = 50
    out["latency_ms"] = 10
    return out


def stub_model(batch: pd.DataFrame) -> pd.DataFrame:
    def answer(row):
        if row.step == "self_check" and int(row.run_id[:2], 16) % 2:
            return ANSWERS["self_check"].replace("true", "false"), None
        return ANSWERS[row.step], None
    return answered(batch, answer)


def test_workflow_over_documents(spark, sf_dir):
    notes = FX.fx_feedback(spark, sf_dir).select("request_id", "content", "source", "customer_id",
                                                 "requested_at")
    t = run_workflow(notes, stub_model, scratch(spark, "runbook"), parallelism=4)
    res = t["results"]
    accepted = I.accepted(notes)
    assert t["rejects"].count() == notes.count() - accepted.count()
    ids = sorted(r.request_id for r in res.select("request_id").collect())
    assert ids == sorted(r.request_id for r in accepted.select("request_id").collect())
    contents = accepted.select("content").distinct().count()
    assert res.filter("not from_cache").count() == contents < res.count()
    ok = res.filter("success and not from_cache")
    failed = res.filter(~F.col("success"))
    assert ok.count() > 0 and failed.count() > 0
    assert failed.filter(~F.col("error").startswith("Self-check failed")).count() == 0
    # rewrite prompts only for approved runs: padded talking points on successes
    assert ok.select(F.size("value_proposition.key_talking_points").alias("n")).distinct().first().n == 3
    assert t["steps"].filter(F.col("step") == "rewrite").count() == ok.count()
    assert t["cache_entries"].count() == ok.count()
    assert res.filter("total_cost_usd is null or normalized_input is null or value_proposition.generated_at is null").count() == 0


T0 = datetime(2024, 1, 1, 12)


def note(request_id, content, **more):
    row = {"request_id": request_id, "content": content, "source": "crm", "requested_at": T0, "provider": None,
           "model": None, "persona": None, "temperature": None}
    return tuple({**row, **more}.values())


SCHEMA = ("request_id string, content string, source string, requested_at timestamp, provider string, model string, "
          "persona string, temperature double")


def garbage_model(note_of: dict[str, str]):
    """Answers by a word of the note: which step returns garbage or fails."""
    def call(batch: pd.DataFrame) -> pd.DataFrame:
        def answer(row):
            text = note_of[row.run_id]
            if f"garbage-{row.step}" in text:
                return "sorry, no JSON here", None
            if row.step == "extract" and "down-extract" in text and row.provider == "google":
                return None, "TimeoutError: no answer"
            if row.step == "extract" and "refused" in text:
                return None, "ValueError: bad prompt"
            return ANSWERS[row.step], None
        return answered(batch, answer)
    return call


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [note("a1", "a plain note to work on"), note("a2", "a plain note to work on"), note("a3", "  a plain note to work on "),
            note("t1", "a plain note to work on", persona="technical"),
            note("o1", "another note, other settings", provider="openai", model="gpt-4o", persona="technical", temperature=0.2),
            note("g1", "note with garbage-extract inside"), note("g2", "note with garbage-self_check inside"),
            note("g3", "note with garbage-rewrite inside"), note("d1", "note with down-extract inside"),
            note("v1", "note that is refused by the model"), note("c1", "note whose result is cached"),
            note("c2", "note whose cached entry is old"), note("c3", "note whose entry is broken"),
            note("x1", "short"), note("x2", None), note("x3", "wrong temperature here", temperature=9.0),
            note("x4", "no credentials for this one", provider="anthropic")]
    notes = spark.createDataFrame(rows, SCHEMA)
    from feedlens.functions import keys
    filled = I.fill_defaults(notes).withColumn("run_id", keys.run_id(F.col("request_id"), F.col("provider"), F.col("model")))
    note_of = {r.run_id: r.content or "" for r in filled.collect()}
    cached = spark.createDataFrame(
        [("note whose result is cached", json.dumps({"run_id": "old-run", "success": True, "total_cost_usd": 0.5,
                                                    "value_proposition": {"headline": "from the cache"}}), T0 - timedelta(minutes=5)),
         ("note whose cached entry is old", json.dumps({"run_id": "too-old", "success": True}), T0 - timedelta(hours=3)),
         ("note whose entry is broken", "{broken", T0 - timedelta(minutes=5))],
        "content string, result_json string, written_at timestamp")
    cached = H.with_cache_key(I.fill_defaults(cached)).select("cache_key", "result_json", "written_at")
    path = scratch(spark, "runbook-cache")
    cached.write.parquet(path)
    t = run_workflow(notes, garbage_model(note_of), scratch(spark, "runbook-mixed"), cache_path=path, configured=["openai", "google"],
                     fallback={"google": ("openai", "gpt-4o-mini")})
    return {k: v.cache() for k, v in t.items()}


def test_every_accepted_request_has_one_result(mixed):
    got = sorted(r.request_id for r in mixed["results"].collect())
    assert got == ["a1", "a2", "a3", "c1", "c2", "c3", "d1", "g1", "g2", "g3", "o1", "t1", "v1"]
    why = {r.request_id: r.reject_reason for r in mixed["rejects"].collect()}
    assert why == {"x1": "too_short", "x2": "missing_content", "x3": "temperature_range", "x4": "provider_not_configured"}


def test_garbage_ends_as_errors_that_are_never_cached(mixed):
    got = {r.request_id: (r.success, r.error) for r in mixed["results"].collect()}
    assert got["g1"] == (False, "extract: unparseable_json")
    assert got["g2"] == (False, "self_check: unparseable_json")
    assert got["g3"] == (False, "rewrite: unparseable_json")
    assert got["v1"] == (False, "extract: call_failed ValueError: bad prompt")
    assert all(ok for k, (ok, _) in got.items() if k not in ("g1", "g2", "g3", "v1"))
    rejects = {(r.step, r.preview) for r in mixed["answer_rejects"].collect()}
    assert ("extract", "sorry, no JSON here") in rejects and ("rewrite", "sorry, no JSON here") in rejects
    ok = mixed["results"].filter("success and not from_cache").select("run_id").collect()
    entries = {json.loads(r.result_json)["run_id"] for r in mixed["cache_entries"].collect()}
    assert entries == {r.run_id for r in ok}


def test_cached_and_shared_results(mixed):
    got = {r.request_id: r for r in mixed["results"].collect()}
    assert got["c1"].run_id == "old-run" and got["c1"].value_proposition.headline == "from the cache" and got["c1"].from_cache
    assert not got["c2"].from_cache and not got["c3"].from_cache
    assert got["a1"].run_id == got["a2"].run_id == got["a3"].run_id != got["t1"].run_id
    assert [got[k].from_cache for k in ("a1", "a2", "a3")] == [False, True, True]


def test_settings_of_each_note_hold(mixed):
    got = {r.request_id: r for r in mixed["results"].collect()}
    assert (got["o1"].provider_used, got["o1"].model_used, got["o1"].value_proposition.persona) == ("openai", "gpt-4o", "technical")
    assert got["t1"].value_proposition.persona == "technical" and got["a1"].value_proposition.persona == "executive"
    assert (got["a1"].provider_used, got["a1"].model_used) == ("google", "gemini-2.5-flash-lite")


def test_retry_and_fallback(mixed):
    steps = {(r.run_id, r.step): r for r in mixed["steps"].collect()}
    got = {r.request_id: r for r in mixed["results"].collect()}
    assert got["d1"].success and steps[got["d1"].run_id, "extract"].provider == "openai"
    assert steps[got["v1"].run_id, "extract"].error == "ValueError: bad prompt"
