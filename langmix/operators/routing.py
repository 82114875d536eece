"""Prediction by model name: rows name the model that is to tag them, and one
plan routes each to its back end.

Two kinds of back end are known. A *classifier* gets the tokens of sentences
and gives, for each, the word index and the logits of every sub-word position.
A *sequence* model gets a prompt and gives the decoded text of tagged items and
the logits of every step. What follows from them is native: the first sub-word
of each word (the walk of :mod:`langmix.operators.align`), the parser of tagged
items, softmax, mean confidence, proxies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langmix.functions.arrays import argmax, bound, max_prob_of_any
from langmix.functions.labels import parse_tagged
from langmix.functions.text import prompt, split_ws
from langmix.operators.batches import bounded
from langmix.operators.scoring import DEFAULT_CONFIDENCE, backend, backend_kind, backends
from langmix.session import ship_package

KINDS = ("classifier", "sequence")
_OUT = "word_ids array<int>, logits array<array<double>>, decoded string"


def require_known(df: DataFrame, model_col: str) -> list[str]:
    """The models that rows name. One that isn't registered as a classifier or
    a sequence model (or a null) is an error before any row is predicted; one
    small aggregation, and at most one name more than are registered come back."""
    known = [n for n in backends() if backend_kind(n) in KINDS]
    rows = df.select(model_col).distinct().limit(len(known) + 1).collect()
    names = sorted((r[0] for r in rows), key=str)
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown model {unknown[0]!r}; registered: {sorted(known)}")
    return names


def first_pieces(word_ids, logits) -> Column:
    """Per word the logits of its first sub-word, in the row: positions
    without a word don't count, and don't interrupt one."""
    pieces = F.filter(F.arrays_zip(F.col(word_ids).alias("w"), F.col(logits).alias("x")), lambda e: e["w"].isNotNull())
    first = bound(lambda z: F.filter(z, lambda e, i: (i == 0) | (F.get(z, i - 1)["w"] != e["w"])), z=pieces)
    return F.transform(first, lambda e: e["x"])


def predict(df: DataFrame, model_col: str, text_col: str) -> DataFrame:
    """All rows and columns with ``tokens``, ``labels`` and ``mean_conf``
    (``DEFAULT_CONFIDENCE`` where nothing was scored). Rows of a batch go to
    their models together; each model is loaded once per task that needs it."""
    names = require_known(df, model_col)
    factories = {n: (backend_kind(n), backend(n)) for n in names}
    src = df.withColumn("_tokens", split_ws(text_col)).withColumn("_prompt", prompt(text_col))
    keep, place = src.columns, {c: i for i, c in enumerate(src.columns)}

    def run(batches):
        import pyarrow as pa

        loaded = {}
        for rb in bounded(batches, "_tokens"):
            rows = [(None, None, None)] * rb.num_rows
            asked: dict[str, list[int]] = {}
            for i, name in enumerate(rb.column(place[model_col]).to_pylist()):
                asked.setdefault(name, []).append(i)
            for name, own in asked.items():
                kind, factory = factories[name]
                model = loaded.get(name) or loaded.setdefault(name, factory())
                given = rb.column(place["_tokens" if kind == "classifier" else "_prompt"]).take(pa.array(own)).to_pylist()
                for i, got in zip(own, model([x or ([] if kind == "classifier" else "") for x in given])):
                    rows[i] = (got[0], got[1], None) if kind == "classifier" else (None, got[1], got[0])
            words, logits, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*rb.columns, pa.array(words, pa.list_(pa.int32())), pa.array(logits, pa.list_(pa.list_(pa.float64()))),
                 pa.array(decoded, pa.string())], names=[*keep, "word_ids", "logits", "decoded"])

    ship_package(df.sparkSession)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields] + [_OUT])
    got = src.mapInArrow(run, schema)
    is_sequence = F.col("decoded").isNotNull()
    parsed = got.withColumn("_p", parse_tagged("decoded")).withColumn(
        "_steps", F.when(is_sequence, F.col("logits")).otherwise(first_pieces("word_ids", "logits")))
    mean = F.aggregate(F.transform("_steps", max_prob_of_any), F.lit(0.0), lambda acc, x: acc + x) / F.size("_steps")
    return parsed.select(
        *df.columns, F.when(is_sequence, F.col("_p.token")).otherwise(F.col("_tokens")).alias("tokens"),
        F.when(is_sequence, F.col("_p.label_id")).otherwise(F.transform("_steps", lambda x: argmax(x).cast("int"))).alias("labels"),
        F.when(F.size("_steps") > 0, mean).otherwise(DEFAULT_CONFIDENCE).alias("mean_conf"))
