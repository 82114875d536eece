"""Toxicity by maximum-scoring segments of token log-odds.

Tokens (runs of letters, lower-cased) and their beginnings have the log-odds of
toxic against other labelled texts under a Dirichlet prior in proportion to the
tokens' overall frequency. Only log-odds at least ``MIN_Z`` standard errors
from 0, for or against, are kept; a token has those of the longest of itself
and its beginnings that kept some, else 0. A token counts once a text, and
copies count as one text: those of one label with the same token sequence.
Every token pays a small ``DRIFT``, so scores fall in ordinary text. One linear
scan finds all maximal-scoring segments of a text. By the extreme-value law of
such segments, n tokens hold a segment of score S or more with probability
1 - exp(-K n exp(-lambda S)): lambda follows from the token scores, K is fitted
on texts that aren't toxic. Segments with an expected count below
``MAX_EXPECTED`` are significant. A text's evidence adds up the normalized
scores lambda S - ln(K n) of its significant segments (the best segment's
alone, if none is), and a logistic fit on the labels, in which both weigh the
same, turns evidence into a probability.

The model learns from at most about ``TRAIN_PER_CLASS`` texts of each label.
Null and empty texts have no segment and evidence 0; a text with tokens but
without a segment has -ln(K n) or 0, whichever is less, so the longer of two
clean texts is the cleaner, and an empty one tells nothing. Rows without a label
or a text aren't learned from; without both labels the share of toxic ones (or
0) is the score. Of segments with equal sums the one that ends first is found
first; no sum depends on it. Repeated rows are scored each. Kept columns named
like the operator's give way to them. Empty tables give no rows."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm.common import fold, labelled_sample, land, table
from langmix.llm.worker import slices, tidy
from langmix.session import ship_package

TRAIN_PER_CLASS = 8000
PRIOR = 0.02         # weight of the prior, as a share of all counts
MIN_Z = 3.5
BEGINNINGS = (7, 6, 5, 4)
DRIFT = 0.05
MAX_EXPECTED = 0.05
SEED = 23

_TOKEN = re.compile(r"[^\W\d_]+").findall


def tokens(text: str | None) -> list[str]:
    return _TOKEN(text.lower()) if text else []


def features(word: str) -> list[str]:
    """A token and its beginnings, longest first."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if n <= len(word)]]


def segments(scores) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one pass: each new
    positive run looks back for the nearest earlier candidate that starts
    lower; if it also ends lower, the two and what lies between become one."""
    out: list[list] = []   # start, end, sum before start, sum through end, link to the nearest lower start
    total = 0.0
    for i, s in scores:
        if s <= 0:
            total += s
            continue
        new = [i[0], i[1], total, total + s, -1]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            new[4] = j
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3], -1]
            del out[j:]
    return [(a, b, high - low) for a, b, low, high, _ in out]


def runs(scores):
    """Runs of one sign as ((start, end), sum)."""
    import numpy as np

    up = scores > 0
    edge = np.flatnonzero(np.diff(up)) + 1
    at = np.concatenate(([0], edge, [len(scores)]))
    sums = np.add.reduceat(scores, at[:-1])
    return zip(zip(at[:-1].tolist(), at[1:].tolist()), sums.tolist())


class Model:
    """Token scores, extreme-value constants and the logistic calibration."""

    def __init__(self, odds: dict[str, float], lam: float = 1.0, k: float = 1.0, slope: float = 0.0,
                 base: float = 0.0):
        self.odds, self.lam, self.k, self.slope, self.base = odds, lam, k, slope, base
        self.starts = {t.rstrip("*")[:4] for t in odds}

    def odds_of(self, word: str) -> float:
        return next((self.odds[f] for f in features(word) if f in self.odds), 0.0)

    def find(self, text: str | None):
        """(number of tokens, maximal segments) of a text."""
        import numpy as np

        words = tokens(text)
        starts = self.starts
        odds = {w: self.odds_of(w) for w in set(words) if w[:4] in starts}
        if not any(odds.values()):
            return len(words), []
        scores = np.array([odds.get(w, 0.0) for w in words]) - DRIFT
        return len(words), segments(runs(scores)) if (scores > 0).any() else []

    def evidence(self, n: int, found) -> tuple[float, list[tuple[int, int, float, float]]]:
        """The evidence, and (start, end, score, expected count) of significant segments."""
        if not n:
            return 0.0, []
        cost = math.log(self.k * n)
        if not found:
            return min(0.0, -cost), []
        normal = [self.lam * s - cost for _, _, s in found]
        good = [(a, b, s, math.exp(-x)) for (a, b, s), x in zip(found, normal) if math.exp(-x) < MAX_EXPECTED]
        return (sum(x for x in normal if math.exp(-x) < MAX_EXPECTED) if good else max(normal)), good

    def probability(self, evidence: float) -> float:
        x = max(-30.0, min(30.0, self.slope * evidence + self.base))
        return 1 / (1 + math.exp(-x))


def _digests(batches):
    """A digest of a text's whole token sequence, which copies share."""
    import pyarrow as pa

    for batch in batches:
        out = [hashlib.blake2b(" ".join(tokens(x.as_py())).encode("utf-8", "replace"), digest_size=16).digest()
               for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("label").cast(pa.int32()),
                                          pa.array(out, pa.binary())], names=["text", "label", "digest"])


def _counts(batches):
    import pyarrow as pa
    from collections import Counter

    for batch in batches:
        seen = (Counter(), Counter())
        for text, label in zip(batch.column("text"), batch.column("label")):
            seen[label.as_py()].update({f for w in set(tokens(text.as_py())) for f in features(w)})
        words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()),
             pa.array([seen[0][w] for w in words], pa.int64())], names=["token", "toxic", "other"])


def _solve_lambda(scores: list[tuple[float, float]]) -> float:
    """The positive root of sum(p exp(lambda s)) = 1; the mean score is negative."""
    low, high = 0.0, 1.0
    f = lambda x: sum(p * math.exp(min(600.0, x * s)) for s, p in scores) - 1
    while f(high) < 0 and high < 1e4:
        high *= 2
    low = 1e-9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _logistic(xs: list[float], ys: list[int]) -> tuple[float, float]:
    """Slope and intercept of a logistic fit by Newton steps, lightly ridged.
    Both labels weigh the same, however many of each there are."""
    import numpy as np

    x = np.stack([np.array(xs), np.ones(len(xs))], 1)
    y, w = np.array(ys, float), np.zeros(2)
    each = np.where(y > 0, len(y) / max(1.0, 2 * y.sum()), len(y) / max(1.0, 2 * (1 - y).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (each * (p - y)) + 1e-3 * w
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        w = w - np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic",
        id_col: str = "doc_id", per_class: int = TRAIN_PER_CLASS) -> Model:
    spark = docs.sparkSession
    ship_package(spark)
    given = labels.select(F.col(f"`{id_col}`"), (F.col(f"`{label_col}`") > 0).cast("int").alias("label"))
    some = labelled_sample(docs, given, "label", per_class, SEED, id_col, text_col).select("text", "label")
    sample = land(some.mapInArrow(_digests, "text string, label int, digest binary").groupBy("label", "digest")
                  .agg(F.min("text").alias("text")).select("text", "label"), "toxicity-sample")
    classes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(classes) < 2:
        share = 1 - 1e-9 if classes.get(1) else 1e-9
        return Model({}, base=math.log(share / (1 - share)))
    counts = land(sample.mapInArrow(_counts, "token string, toxic bigint, other bigint").groupBy("token")
                  .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "toxicity-counts")
    t, o = counts.agg(F.sum("toxic"), F.sum("other")).first()
    t, o = t or 0, o or 0
    both = F.col("toxic") + F.col("other")
    yt, yo, weight = F.col("toxic") + PRIOR * both, F.col("other") + PRIOR * both, PRIOR * (t + o)
    delta = F.log(yt / (t + weight - yt)) - F.log(yo / (o + weight - yo))
    kept = counts.select("token", delta.alias("d"), (delta / F.sqrt(1 / yt + 1 / yo)).alias("z"),
                         (yo / (o + weight)).alias("p")).where(F.abs("z") >= MIN_Z).collect()  # of a bounded sample
    model = Model({r["token"]: r["d"] for r in kept})
    if not any(r["d"] > DRIFT for r in kept):
        share = classes[1] / sum(classes.values())
        return Model({}, base=math.log(share / (1 - share)))
    scores = [(r["d"] - DRIFT, r["p"]) for r in kept]
    scores.append((-DRIFT, max(0.0, 1 - sum(p for _, p in scores))))
    model.lam = _solve_lambda(scores)
    shared = spark.sparkContext.broadcast(model)

    def best(batches):
        import pyarrow as pa

        for batch in batches:
            n, found = zip(*[shared.value.find(x.as_py()) for x in batch.column("text")]) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(n, pa.int64()), pa.array([max((s for *_, s in f), default=0.0) for f in found], pa.float64()),
                 batch.column("label")], names=["n", "best", "label"])

    null = sample.mapInArrow(best, "n bigint, best double, label int").where("label = 0 AND n > 0")
    m, mass = null.agg(F.count(F.lit(1)), F.sum(F.col("n") * F.exp(F.col("best") * -model.lam))).first()
    model.k = min(1.0, max(1e-9, (m or 1) / (mass or 1.0)))
    got = [(r["evidence"], r["label"]) for r in score(sample, model, keep=("label",)).select("evidence", "label").collect()]
    model.slope, model.base = _logistic([x for x, _ in got], [y for _, y in got])
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``evidence``, ``probability`` and the significant
    ``passages`` (first token, end, score, expected count) of every whole text."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = tuple(c for c in keep if c.lower() not in ("evidence", "probability", "passages"))
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))
    span = "passages array<struct<start: int, end: int, score: double, expected: double>>"

    def run(batches):
        import pyarrow as pa

        m = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()),
                                   ("expected", pa.float64())]))
        for batch in slices(batches):
            got = [m.evidence(*m.find(x.as_py())) for x in batch.column(len(keep))]
            cols = [pa.array([e for e, _ in got], pa.float64()),
                    pa.array([m.probability(e) for e, _ in got], pa.float64()),
                    pa.array([[dict(zip(("start", "end", "score", "expected"), s)) for s in found] for _, found in got],
                             kind)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *cols],
                                             names=[*keep, "evidence", "probability", "passages"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
                       + ["evidence double", "probability double", span])
    return src.mapInArrow(tidy(run), schema)


def op8_toxic_segments(spark, sf_dir):
    """Toxicity of every whole document, learned from the folds not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    got = score(docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out")), model,
                keep=("doc_id", "held_out"))
    return got.select("doc_id", "held_out", F.col("probability").alias("score"),
                      (F.col("probability") >= 0.5).cast("int").alias("predicted"),
                      F.size("passages").alias("n_passages"))


QUERIES = {"op8_toxic_segments": op8_toxic_segments}
SQL: dict[str, str] = {}
