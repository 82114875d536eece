"""Quality by ordinal cumulative-link regression on graded ratings.

A text's hashed features share one weight vector; ordered thresholds cut the
resulting score into grades: P(grade <= k) = sigmoid(threshold_k - score).
From these follow the expected grade and the tail probability P(grade >= g),
by which documents are selected.

Features are hashed words, word shapes (character classes, runs collapsed, the
first ``SHAPE_CHARS`` of them: a shape is a class of words, not their text) and
two steps of style (share of words that repeat their predecessor, share of
distinct words), all in one hashed space, log counts scaled to unit length.

The model learns on the driver from at most about ``TRAIN_ROWS`` rated rows;
null ratings or texts aren't used. With fewer than two grades in the sample,
that grade (or null without any) is expected. Texts that are null or have no
words have the lowest grade with certainty and tail probability 0. Repeated
rows are scored each, extra columns pass through, and empty tables give none."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm.common import labelled_sample, table, without
from langmix.llm.worker import cached, slices, tidy
from langmix.session import ship_package

BUCKETS = 1 << 15
TRAIN_ROWS = 12000
EPOCHS = 8
RATE = 0.3
RIDGE = 1e-6
SEED = 5
KEEP_TAIL = 0.5
SHAPE_CHARS = 12
CACHE_WORDS = 100_000

_RUN = re.compile(r"(.)\1+")
_SHAPE = str.maketrans({**{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"},
                        **{c: "0" for c in "0123456789"}})


def _bucket(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % BUCKETS


def shape(word: str) -> str:
    """Character classes of a word, each run shortened to one or two."""
    s = "".join(c if c < "\x7f" or not c.isalpha() else "X" if c.isupper() else "x" for c in word.translate(_SHAPE))
    return _RUN.sub(r"\1\1", s)[:SHAPE_CHARS]


class Features:
    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        import numpy as np

        got = self.old.get(word)
        if got is None:
            got = np.array([_bucket("w:" + word.lower().strip(".,;:!?")), _bucket("s:" + shape(word))], np.int32).tobytes()
        if len(word) <= 64:
            if len(self.young) >= CACHE_WORDS:
                self.young, self.old = {}, self.young
            self.young[word] = got
        return got

    def of(self, text: str | None):
        """(buckets, values of unit length), or None without words."""
        import numpy as np

        words = text.split() if text else []
        if not words:
            return None
        found = list(map(self.young.get, words))
        if None in found:
            found = [self._word(w) if x is None else x for w, x in zip(words, found)]
        both = np.frombuffer(b"".join(found), np.int32)
        same = both[2::2] == both[:-2:2]
        style = [_bucket(f"repeats:{int(10 * same.mean()) if len(same) else 0}"),
                 _bucket(f"distinct:{int(10 * len(set(words)) / len(words))}")]
        index, count = np.unique(both, return_counts=True)
        index = np.concatenate((index, style))
        value = np.concatenate((np.log1p(count), np.full(2, max(1.0, float(np.log1p(count).max())))))
        return index, value / np.linalg.norm(value)


def features() -> Features:
    return cached("quality", Features)


class Model:
    """Shared weights, ordered thresholds and the grades between them."""

    def __init__(self, grades: list[float], weights, thresholds):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def chances(self, found):
        """Probability of every grade, lowest first."""
        import numpy as np

        if found is None or len(self.grades) < 2:
            return np.eye(len(self.grades) or 1)[0]
        index, value = found
        below = 1 / (1 + np.exp(-np.clip(self.thresholds - self.weights[index] @ value, -30, 30)))
        return np.diff(np.concatenate(([0.0], below, [1.0])))


def learn(rows: list[tuple], grades: list[float]) -> Model:
    """Stochastic ascent (AdaGrad) on the likelihood of (buckets, values, grade index)."""
    import numpy as np

    weights, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    share = np.cumsum(np.bincount([y for *_, y in rows], minlength=len(grades)))[:-1] / max(1, len(rows))
    share = np.clip(share, 1e-4, 1 - 1e-4)
    cuts = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(len(share)))
    cut_seen, rng = np.full(len(cuts), 1e-6), np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            index, value, y = rows[i]
            s = float(weights[index] @ value)
            hi = 1 / (1 + np.exp(-min(30, max(-30, cuts[y] - s)))) if y < len(cuts) else 1.0
            lo = 1 / (1 + np.exp(-min(30, max(-30, cuts[y - 1] - s)))) if y else 0.0
            grad = (hi + lo - 1) * value - RIDGE * weights[index]   # of the log likelihood
            seen[index] += grad * grad
            weights[index] += RATE * grad / np.sqrt(seen[index])
            p = max(1e-9, hi - lo)
            for j, g in ((y, hi * (1 - hi) / p), (y - 1, -lo * (1 - lo) / p)):
                if 0 <= j < len(cuts):
                    cut_seen[j] += g * g
                    cuts[j] += 0.1 * RATE * g / np.sqrt(cut_seen[j])
            cuts = np.maximum.accumulate(cuts)
    return Model(grades, weights, cuts)


def fit(docs: DataFrame, ratings: DataFrame, text_col: str = "text", grade_col: str = "quality",
        id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """Model of rated rows; a bounded sample of them reaches the driver."""
    import numpy as np

    ship_package(docs.sparkSession)
    given = ratings.select(F.col(f"`{id_col}`"), F.col(f"`{grade_col}`").cast("double").alias("grade")).where("NOT isnan(grade)")
    sample = labelled_sample(docs, given, "grade", train_rows, SEED, id_col, text_col, classes=False)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                found = features().of(batch.column("text")[i].as_py())
                if found is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column("id")[i].as_py()], pa.string()),
                         pa.array([batch.column("grade")[i].as_py()], pa.float64()),
                         pa.array([found[0].astype("int32").tobytes()], pa.binary()),
                         pa.array([found[1].astype("float32").tobytes()], pa.binary())],
                        names=["id", "grade", "buckets", "vals"])

    got = sample.select(F.col("id").cast("string").alias("id"), "text", F.col("label").alias("grade")) \
        .mapInArrow(tidy(run, "quality"), "id string, grade double, buckets binary, vals binary").collect()
    got.sort(key=lambda r: (r["id"] or "", r["grade"], bytes(r["buckets"])))  # the order of tasks doesn't matter
    grades = sorted({r["grade"] for r in got})
    if len(grades) < 2:
        return Model(grades, np.zeros(BUCKETS), np.zeros(0))
    return learn([(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["vals"], np.float32).astype(float),
                   grades.index(r["grade"])) for r in got], grades)


def predict(docs: DataFrame, model: Model, at_least: float = 1.0, text_col: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) with ``expected_grade`` and
    ``tail_prob``, the probability of a grade of ``at_least``."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = without(docs, "expected_grade", "tail_prob")
    shared = spark.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    used = list(dict.fromkeys([*keep, text_col]))   # the text moves once
    src, text = docs.select(*[F.col(f"`{c}`") for c in used]), used.index(text_col)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        grades = np.array(m.grades)
        for batch in slices(batches):
            p = [m.chances(features().of(x.as_py())) for x in batch.column(text)]
            expected = [float(x @ grades) if len(grades) else None for x in p]
            tail = [float(x[grades >= at_least].sum()) if len(grades) else None for x in p]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(expected, pa.float64()), pa.array(tail, pa.float64())],
                names=[*keep, "expected_grade", "tail_prob"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return src.mapInArrow(tidy(run, "quality"), ", ".join([*fields, "expected_grade double", "tail_prob double"]))


def select(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose tail probability is at least ``KEEP_TAIL`` (all,
    if there was nothing to learn from), with their own columns."""
    got = predict(docs, model).where(F.coalesce(F.col("tail_prob"), F.lit(1.0)) >= KEEP_TAIL)
    return got.select(*[F.col(f"`{c}`") for c in docs.columns]) \
        if not {"expected_grade", "tail_prob"} & {c.lower() for c in docs.columns} else got


def op5_ordinal_quality(spark, sf_dir):
    """Expected grade and P(grade >= 1) of every whole document."""
    docs = table(spark, sf_dir, "documents")
    got = predict(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return got.select("doc_id", "expected_grade", "tail_prob",
                      (F.coalesce(F.col("tail_prob"), F.lit(1.0)) >= KEEP_TAIL).alias("keep"))


QUERIES = {"op5_ordinal_quality": op5_ordinal_quality}
SQL: dict[str, str] = {}
