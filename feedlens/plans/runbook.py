"""The four-step workflow as a batch job over a table of notes.

notes → checks (V1, V4, M9) → cache lookup → in-batch dedupe → normalise and redact → for each step:
prompts → model (user function, mapInPandas) ⇢ durable table, retry, fallback ⇢ parse → repair →
conform ⇢ durable table → gate before rewrite → results, steps, cache entries.

Every accepted request gets exactly one result: its own, the one of the request with the same inputs
that was computed for it, or the cached one. Every model answer is written to parquet under `out` before
it is used, so a lost executor or a second action never pays for a call twice. An answer that cannot be
read, or a call that failed, ends its run as an error, which is never cached.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import keys
from ..functions import text as X
from ..functions.exact import rsum
from ..operators import cache as H
from ..operators import cost as C
from ..operators import generate as G
from ..operators import ingest as I
from ..operators import prompts as P
from ..operators import repair as RP
from ..operators import responses as R
from ..operators import results as W

ModelFn = Callable[[pd.DataFrame], pd.DataFrame]


class _Job:
    """One run of the workflow: where it writes and how it calls the model."""

    def __init__(self, spark, fn: ModelFn, out: str, parallelism: int | None, fallback: dict[str, tuple[str, str]],
                 pause: Callable[[float], None]):
        self.spark, self.fn, self.out, self.parallelism, self.fallback = spark, fn, out, parallelism, fallback
        self.pause = pause

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.out}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _call(self, prompts: DataFrame, step: str, attempt: int, preference: int) -> DataFrame:
        rows = G.generate_batch(prompts, self.fn, self.parallelism)
        kind = F.regexp_extract(F.coalesce("error", F.lit("")), r"^(\w+)", 1)
        rows = rows.withColumns({"success": F.col("error").isNull(), "attempt": F.lit(attempt),
                                 "preference": F.lit(preference), "error_kind": F.when(kind != "", kind)})
        return self.written(rows, f"responses/step={step}/preference={preference}/attempt={attempt}")

    def answers(self, prompts: DataFrame, step: str) -> DataFrame:
        """One answer per prompt: retried while the error allows (M6), then the fallback provider (M7)."""
        prompts = self.written(P.with_system(prompts.withColumn("step", F.lit(step))), f"prompts/step={step}")
        tried = self._call(prompts, step, 1, 1)
        for attempt in range(2, S.MAX_ATTEMPTS + 1):
            again = G.retry_select(tried).select("run_id")
            if again.isEmpty():
                break
            self.pause(G.wait_seconds(attempt - 1))  # every failed call has ended before, so none is tried too early
            tried = tried.unionByName(self._call(prompts.join(again, "run_id", "left_semi"), step, attempt, 1))
        if self.fallback:
            failed = G.latest_attempt(tried).filter(~F.col("success")).select("run_id")
            to = lambda k: F.coalesce(*[F.when(F.col("provider") == p, F.lit(v[k]))
                                        for p, v in self.fallback.items()])
            other = (prompts.join(failed, "run_id", "left_semi").filter(F.col("provider").isin(*self.fallback))
                     .withColumns({"provider": to(0), "model": to(1)}))
            tried = tried.unionByName(self._call(other, step, 1, 2))
        return G.provider_fallback(tried).withColumn("step", F.lit(step))

    def typed(self, answers: DataFrame, step: str, repair, conform) -> DataFrame:
        """Parsed, repaired and conformed answers; what cannot be read stays out of repair and is invalid."""
        p = self.written(R.parse(answers.select("run_id", "content", "error"), step), f"parsed/step={step}")
        read = F.col("json_text").isNotNull() & F.col("error").isNull()
        good = conform(repair(p.filter(read).select("run_id", "type_errors", "parsed.*")))
        why = F.when(F.col("error").isNotNull(), F.concat(F.lit("call_failed "), "error")).otherwise(F.lit("unparseable_json"))
        bad = p.filter(~read).select("run_id", F.array(why).alias("violations"), F.lit(False).alias("valid"))
        return self.written(good.unionByName(bad, allowMissingColumns=True), f"typed/step={step}")


def run_workflow(notes: DataFrame, fn: ModelFn, out: str, provider: str = S.DEFAULT_PROVIDER,
                 model: str = S.DEFAULT_MODEL, persona: str = S.DEFAULT_PERSONA, parallelism: int | None = None,
                 cache_path: str | None = None, now_col: str = "requested_at", configured: list[str] | None = None,
                 fallback: dict[str, tuple[str, str]] | None = None,
                 pause: Callable[[float], None] = time.sleep) -> dict[str, DataFrame]:
    """Run the workflow; returns the written tables (results, steps, rejects, answer rejects, cache entries).

    Provider, model, persona and temperature are columns of `notes`; the arguments fill what a note
    leaves out. `configured` lists providers with credentials; `fallback` maps a provider to the
    (provider, model) that takes over its failed calls. `pause` waits so many seconds before calls are tried again.
    """
    spark = notes.sparkSession
    job = _Job(spark, fn, out, parallelism, fallback or {}, pause)
    for name, value in (("provider", provider), ("model", model), ("persona", persona)):
        own = F.coalesce(F.col(name), F.lit(value)) if name in notes.columns else F.lit(value)
        notes = notes.withColumn(name, own)
    n = I.check_requests(I.fill_defaults(notes), configured)
    if now_col not in n.columns:
        n = n.withColumn(now_col, F.current_timestamp())
    # the clock and any other volatile input are fixed here
    n = job.written(n.withColumn("run_id", keys.run_id(F.col("request_id"), F.col("provider"), F.col("model"))), "requests")
    rejects = job.written(n.filter("reject_reason is not null").select("request_id", "reject_reason"), "rejects")
    acc = n.filter("reject_reason is null").drop("reject_reason")
    acc = acc.withColumn("content", X.strip_ws(F.col("content")))
    acc = H.with_cache_key(acc)

    # cache: hits take their cached result; identical misses in this batch are computed once
    hits = None
    misses = acc
    if cache_path is not None:
        looked = job.written(H.lookup(acc, spark.read.parquet(cache_path), now_col=now_col), "looked")
        usable = F.col("hit") & F.coalesce(F.from_json("result_json", S.RESULT)["success"], F.lit(False))
        looked = looked.withColumn("hit", usable)
        hits = H.results_of_hits(H.hits(looked))
        misses = H.misses(looked).drop("hit", "result_json", "written_at")
    # persona and temperature change the result but are no part of the service's cache key (K6)
    same = keys.cache_key_v2(*[F.col(c) for c in ("content", "provider", "model", "persona", "temperature")])
    led = job.written(H.leaders(misses.withColumn("same_key", same), by="same_key", settled=True), "misses")
    todo = job.written(led.filter("request_id = leader_request_id").drop("leader_request_id", "same_key"), "todo")
    base = todo.select("run_id", "provider", "model", "persona")

    def prompts(rows: DataFrame, text) -> DataFrame:
        return rows.select("run_id", "provider", "model", text.alias("prompt"))

    # 1 ingest: the model's view of the note, with our own redaction as fallback and on top
    a_ing = job.answers(prompts(todo, P.ingest_prompt(F.col("content"), F.col("source"))), "ingest")
    note = todo.select(F.col("run_id").alias("request_id"), "content")
    norm = I.merge_ingest(note, a_ing.filter("error is null").select(F.col("run_id").alias("request_id"), "content"))
    norm = job.written(norm.withColumnRenamed("request_id", "run_id")
                       .join(todo.select("run_id", F.col(now_col).alias("processed_at")), "run_id"), "normalized")
    clean = base.join(norm.select("run_id", "cleaned_content"), "run_id")
    # 2 extract
    a_ext = job.answers(prompts(clean, P.extract_prompt(F.col("cleaned_content"))), "extract")
    ext = job.typed(a_ext, "extract", RP.repair_extract, RP.conform_extract)
    ej = ext.filter("valid").select("run_id", P.extracted_json().alias("ej"))
    # 3 self-check
    a_sc = job.answers(prompts(clean.join(ej, "run_id"), P.self_check_prompt(F.col("cleaned_content"), F.col("ej"))),
                       "self_check")
    sc = job.typed(a_sc, "self_check", RP.repair_self_check, RP.conform_self_check)
    # gate: only approved, valid self-checks get a rewrite prompt (no call for rejected rows)
    ok = W.gate_approved(sc.filter("valid")).select("run_id")
    a_rw = job.answers(prompts(base.join(ok, "run_id").join(ej, "run_id"), P.rewrite_prompt(F.col("ej"), F.col("persona"))),
                       "rewrite")

    def repair_rewrite(df: DataFrame) -> DataFrame:
        asked = base.select("run_id", F.col("persona").alias("_asked"))
        df = df.join(asked, "run_id").withColumn("persona", F.coalesce("persona", "_asked")).drop("_asked")
        return RP.repair_value_prop(df)
    vp = job.typed(a_rw, "rewrite", repair_rewrite, RP.conform_value_prop)

    # steps table with cost (C1) and per-run totals
    answers = a_ing.unionByName(a_ext).unionByName(a_sc).unionByName(a_rw)
    steps = job.written(C.with_cost(answers.select(
        "run_id", "step", "provider", "model", F.coalesce("tokens_input", F.lit(0)).alias("tokens_input"),
        F.coalesce("tokens_output", F.lit(0)).alias("tokens_output"), "latency_ms", "error")), "steps")
    unread = [R.parse_rejects(spark.read.parquet(f"{out}/parsed/step={s}")).select(
        "run_id", F.lit(s).alias("step"), "reason", "preview") for s in ("extract", "self_check", "rewrite")]
    answer_rejects = job.written(unread[0].unionByName(unread[1]).unionByName(unread[2]), "answer_rejects")
    totals = steps.groupBy("run_id").agg(rsum("cost_usd").alias("total_cost_usd"), F.sum("latency_ms").alias("total_latency_ms"))
    own = (W.outcome(norm, ext, sc, vp).join(totals, "run_id", "left")
           .join(todo.select("run_id", F.col("provider").alias("provider_used"), F.col("model").alias("model_used"),
                             F.col("request_id").alias("leader_request_id")), "run_id"))
    own = job.written(own, "computed")
    # every miss takes its leader's result; hits bring their own
    cols = [f.name for f in S.RESULT.fields]
    res = led.select("request_id", "cache_key", "leader_request_id").join(own, "leader_request_id").select(
        "request_id", "cache_key", *cols, (F.col("request_id") != F.col("leader_request_id")).alias("from_cache"))
    if hits is not None:
        res = res.unionByName(hits)
    res = job.written(res, "results")
    fresh = led.filter("request_id = leader_request_id").select("run_id", "cache_key", F.col(now_col).alias("written_at"))
    entries = job.written(H.entries_for(own.drop("leader_request_id").join(fresh, "run_id")), "cache_entries")
    return {"results": res, "steps": steps, "rejects": rejects, "answer_rejects": answer_rejects, "cache_entries": entries}
