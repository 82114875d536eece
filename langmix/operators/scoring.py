"""Scoring: logits -> prediction/confidence, sentence confidence, the
confidence proxy, and the user-model scoring plug-in."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langmix.functions.arrays import max_prob
from langmix.operators.batches import bounded
from langmix.session import ship_package

# --- Fixed values -----------------------------------------------------------
DEFAULT_CONFIDENCE = 0.80   # used when a sentence has no scored word
PRECISION_FACTOR = 0.985
RECALL_FACTOR = 0.972
F1_FACTOR = 0.978
# -----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mean_confidence(word_rows: DataFrame, sentences: DataFrame, keys: list[str],
                    conf: str = "conf", default: float = DEFAULT_CONFIDENCE) -> DataFrame:
    """Mean confidence per sentence over its scored words; sentences without
    any word get ``default``."""
    means = word_rows.groupBy(*keys).agg(F.avg(conf).alias("_m"), F.count(F.lit(1)).alias("n_words"))
    return (sentences.select(*keys).join(means, keys, "left")
            .select(*keys, F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"),
                    F.coalesce("_m", F.lit(default)).alias("mean_conf")))


def sequence_confidence(step_rows: DataFrame, sentences: DataFrame, keys: list[str],
                        logits: str = "logits") -> DataFrame:
    """Generated-sequence confidence: mean over steps of the top softmax
    probability; ``DEFAULT_CONFIDENCE`` when a sequence has no step."""
    probs = step_rows.select(*keys, max_prob(logits).alias("conf"))
    return mean_confidence(probs, sentences, keys)


# name -> factory returning a prediction back end, and its kind; dispatch by model name
_BACKENDS: dict[str, Callable] = {}
_KINDS: dict[str, str] = {}


def register_backend(name: str, factory: Callable, kind: str = "plug-in") -> None:
    _BACKENDS[name], _KINDS[name] = factory, kind


def backends() -> list[str]:
    return sorted(_BACKENDS)


def backend_kind(name: str) -> str:
    backend(name)
    return _KINDS[name]


def backend(name: str) -> Callable:
    """The prediction back end registered under ``name``; an unknown name is
    an error, never a silent default."""
    try:
        return _BACKENDS[name]
    except KeyError:
        raise ValueError(f"unknown model {name!r}; registered: {sorted(_BACKENDS)}") from None


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))


def confidence_proxy(p) -> Column:
    """Confidence turned into metric-shaped numbers. No truth is used, so
    these are *proxies*, not measurements."""
    q = _clamp(_c(p).cast("double"))
    den = q + F1_FACTOR
    f1 = F.when(den == 0, F.lit(0.0)).otherwise(_clamp(2 * q * F1_FACTOR / den))
    return F.struct(q.alias("accuracy"), _clamp(q * PRECISION_FACTOR).alias("precision"),
                    _clamp(q * RECALL_FACTOR).alias("recall"), f1.alias("f1"))


def score_batches(df: DataFrame, ids_col: str,
                  scorer_factory: Callable[[], Callable[[list[list[int]]], list[list[list[float]]]]],
                  batch_size: int = 16) -> DataFrame:
    """User model scoring through ``mapInArrow``: all columns pass through,
    ``logits`` is added. The factory loads the
    model once per task; the scorer gets ``batch_size`` sequences at a time
    (numpy views into the Arrow buffer, no copy) and returns one
    ``positions x classes`` array per sequence. The nested result is built
    from numpy offsets, so no per-element Python object is created, and
    nothing accumulates in the worker across Arrow batches."""
    import numpy as np
    import pyarrow as pa

    from langmix.operators.align import pass_through

    keep, schema = pass_through(df, ["logits"])

    def run(batches):
        score = scorer_factory()
        for rb in bounded(batches, ids_col):
            col = rb.column(ids_col)
            values = col.values.to_numpy(zero_copy_only=False)
            offs = col.offsets.to_numpy()
            seqs = [values[offs[i]:offs[i + 1]] for i in range(len(col))]
            mats = []
            for i in range(0, len(seqs), batch_size):
                mats.extend(np.asarray(m, dtype=np.float64).reshape(len(s), -1) if len(s) else None
                            for s, m in zip(seqs[i:i + batch_size], score(seqs[i:i + batch_size])))
            width = next((m.shape[1] for m in mats if m is not None), 0)
            mats = [np.zeros((0, width)) if m is None else m for m in mats]
            lengths = np.array([m.shape[0] for m in mats], dtype=np.int64)
            flat = np.concatenate([m.ravel() for m in mats]) if mats else np.zeros(0)
            inner = pa.ListArray.from_arrays(
                pa.array((np.arange(lengths.sum() + 1) * width).astype(np.int32)), pa.array(flat))
            outer = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)),
                                             inner)
            yield pa.RecordBatch.from_arrays([rb.column(k) for k in keep] + [outer], names=[*keep, "logits"])

    ship_package(df.sparkSession)
    return df.mapInArrow(run, f"{schema}, logits array<array<double>>")
