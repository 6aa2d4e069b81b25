"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are rows marked as good; the unlabelled set is any web text. With class prior pi the
risk of a scorer g is pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)]); where the bracket turns
negative, the step is taken against it. The scorer is a small two-layer network on statistics of the
whole text; l is the logistic loss, so the score is sigmoid(g).

The prior is estimated from positives and unlabelled rows alone: a first classifier tells the two
apart, and pi is the smallest ratio of their shares above a score (best-bin estimation), on rows that
this classifier was not fitted on. No negative label is used.

It learns from at most `SAMPLE` rows of either kind, the first by a hash of their id.

Edge cases: null and empty texts have statistics of zero and are scored like any text; null labels
are no labels; an id with several labels is positive if any is; without positives or unlabelled rows
every score is 0.5; an empty table gives no rows; repeated rows score alike; extra columns are kept
by `with_score`.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, join_summary, settle

FOLDS, HELD = 3, 1
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE = 16, 60, 512, 0.01
SEED = 7

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_SENTENCE = np.zeros(256, bool)
_SENTENCE[[ord(c) for c in ".,;:'\"-?()"]] = True


def statistics(text: str | None) -> np.ndarray:
    """Size, repetition, case, symbol and line statistics of a whole text."""
    text = text or ""
    byte = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = max(1, int(byte.sum()))
    alpha, blank, digit = byte[_ALPHA].sum(), byte[_BLANK].sum(), byte[48:58].sum()
    marks = byte[_SENTENCE].sum()
    w = text.split()
    n = max(1, len(w))
    count = Counter(w)
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(a == b for a, b in zip(w, w[1:]))
    two = len(set(zip(w, w[1:])))
    return np.array([
        np.log1p(len(w)), size / n / 10, len(count) / n, same / n, two / n,
        max(count.values(), default=0) / n, byte[65:91].sum() / max(1, alpha), alpha / size, digit / size,
        (size - alpha - blank - digit - marks) / size * 10, marks / size * 10, byte[ord(".")] / n,
        byte[ord(",")] / n, byte[ord("!")] / n, byte[ord("|")] / n, np.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)), np.log1p(len(w) / max(1, len(lines)))])


@dataclass
class Net:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    prior: float = 0.5

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w2 + self.b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(p: np.ndarray, u: np.ndarray, prior: float | None) -> Net:
    """Adam on the non-negative risk; with `prior` None on plain positive-against-unlabelled loss."""
    rng = np.random.default_rng(SEED)
    both = np.concatenate([p, u])
    net = Net(both.mean(0), both.std(0) + 1e-6, rng.normal(0, 0.3, (p.shape[1], HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, 0.3, HIDDEN), np.zeros(1), prior if prior is not None else 0.5)
    names = ("w1", "b1", "w2", "b2")
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    steps = max(1, max(len(p), len(u)) // BATCH)
    t = 0
    for epoch in range(EPOCHS):
        for _ in range(steps):
            xp, xu = (x[rng.integers(0, len(x), BATCH)] for x in (p, u))
            x = np.concatenate([xp, xu])
            h = net.hidden(x)
            g = h @ net.w2 + net.b2[0]
            gp, gu = g[:BATCH], g[BATCH:]
            # derivatives of log(1 + exp(-g)) and log(1 + exp(g)) by g
            down_p, up_p, up_u = -_sigmoid(-gp), _sigmoid(gp), _sigmoid(gu)
            if prior is None:
                d = np.concatenate([down_p, up_u])
            else:
                bracket = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
                if bracket >= 0:
                    d = np.concatenate([prior * (down_p - up_p), up_u])
                else:
                    d = -np.concatenate([-prior * up_p, up_u])
            d /= BATCH
            back = np.outer(d, net.w2) * (1 - h * h)
            z = np.clip((x - net.mean) / net.scale, -8, 8)
            grads = {"w1": z.T @ back, "b1": back.sum(0), "w2": h.T @ d, "b2": np.array([d.sum()])}
            t += 1
            for k in names:
                grad = grads[k] + 1e-4 * getattr(net, k)
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                step = RATE * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
                setattr(net, k, getattr(net, k) - step)
    return net


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Best-bin estimate of the share of positives in `u`, with a confidence margin on both shares."""
    net = train(p[::2], u[::2], None)
    sp, su = np.sort(net.logit(p[1::2])), np.sort(net.logit(u[1::2]))
    cut = np.quantile(sp, np.linspace(0, 0.9, 91))  # shares of positives above from 1 to a tenth
    qp = 1 - np.searchsorted(sp, cut) / len(sp)
    qu = 1 - np.searchsorted(su, cut) / len(su)
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    best = int(((qu + slack) / qp).argmin())
    return float(np.clip(qu[best] / qp[best], 0.01, 0.99))


def learn(p: np.ndarray, u: np.ndarray) -> Net | None:
    if len(p) < 4 or len(u) < 4:
        return None
    return train(p, u, class_prior(p, u))


def fit(docs: DataFrame, labels: DataFrame) -> Net | None:
    """Learn from the fitting folds: positives by label, unlabelled rows whatever their label."""
    taught = fold(F.col("doc_id"), FOLDS) != HELD
    order = F.xxhash64(F.lit("pu"), "doc_id")
    good = (labels.filter(taught & (F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
            .orderBy(order, "doc_id").limit(SAMPLE).withColumn("positive", F.lit(1)))
    web = (docs.filter(taught & F.col("doc_id").isNotNull()).select("doc_id").distinct()
           .orderBy(F.xxhash64(F.lit("web"), "doc_id"), "doc_id").limit(SAMPLE).withColumn("positive", F.lit(0)))
    chosen = settle(good.unionByName(web))
    # of rows repeating an id, the one whose text hashes lowest, so that the bound holds for rows too
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("positive", "doc_id")  # 2 * SAMPLE ids
            .agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("one")).select("positive", "one.text"))
    got = rows.select("positive", _statistics()("text").alias("x")).toPandas()  # at most 2 * SAMPLE rows
    x = {k: np.stack(v.to_numpy()) for k, v in got.groupby("positive")["x"]} if len(got) else {}
    none = np.zeros((0, 1))
    order_rows = {k: v[np.lexsort(v.T)] for k, v in x.items()}  # rows arrive in any order
    rng = np.random.default_rng(SEED)
    mixed = {k: v[rng.permutation(len(v))] for k, v in sorted(order_rows.items())}
    return learn(mixed.get(1, none), mixed.get(0, none))


def _statistics():
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t).tolist() for t in texts])
    return run


def with_score(docs: DataFrame, net: Net | None, name: str = "score") -> DataFrame:
    """`docs` with the probability-like score of being good."""
    if net is None:
        return docs.withColumn(name, F.lit(0.5))
    shared = SparkSession.active().sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array([statistics(t) for t in texts])) if len(texts) else [], dtype=float)
    return docs.withColumn(name, run("text"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return (with_score(docs.select("doc_id", "text"), fit(docs, labels))
            .select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))
