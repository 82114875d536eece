"""The request loop as a Structured Streaming job.

Each incoming message is normalized, tagged against a static lexicon,
looked up in a static ground-truth table, measured and rendered; for signed-in
users the message and the rendered reply are appended to the history table.

A message whose text has a ground truth gets the support-weighted metrics of
its tags against it; any other gets the proxies that follow from the mean
share of its tagged tokens (``metric_source`` says which).

Tags are looked up in the row against a lexicon prepared once, before the
stream starts; the only join is that with the ground truth. ``foreachBatch``
runs the batch operators on each micro-batch, so the job keeps no state. Each
batch is written to its own ``batch_id=`` folder with overwrite, so a retried
batch replaces its output instead of duplicating it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.functions.labels import annotate
from langmix.functions.text import normalize_text
from langmix.operators.lookup import look_up
from langmix.operators.metrics import sentence_prf
from langmix.operators.scoring import DEFAULT_CONFIDENCE, confidence_proxy
from langmix.operators.tagging import PreparedLexicon, tag_lines

METRICS = ("accuracy", "precision", "recall", "f1")


def tag_messages(batch: DataFrame, lexicon: PreparedLexicon, truth: DataFrame, keys: list[str],
                 user_col: str, text_col: str, marks: dict[int, str] | None = None) -> DataFrame:
    """Batch logic of one micro-batch: a tagged and measured reply for each
    message. ``truth`` is a look-up by digest (hi, lo, ner_tags)."""
    msgs = batch.select(*keys, user_col, text_col, normalize_text(text_col).alias("norm_text"))
    tagged = tag_lines(msgs, lexicon, msgs.columns, "norm_text", keep_empty=True, confidence=True)
    replies = look_up(tagged, "norm_text", truth.withColumnRenamed("ner_tags", "_truth"), ["_truth"])
    matched = F.col("_truth").isNotNull()
    mean = F.aggregate("shares", F.lit(0.0), lambda acc, x: acc + x) / F.size("shares")
    proxy = confidence_proxy(F.when(F.size("shares") > 0, mean).otherwise(DEFAULT_CONFIDENCE))
    replies = replies.withColumn("_m", F.when(matched, sentence_prf("_truth", "ner_tags")).otherwise(proxy))
    return replies.select(
        *keys, user_col, text_col, "norm_text",
        F.coalesce(annotate("tokens", "ner_tags", marks), F.lit("")).alias("reply"), matched.alias("matched"),
        F.when(matched, F.lit("truth")).otherwise(F.lit("proxy")).alias("metric_source"), *[f"_m.{m}" for m in METRICS])


def history_rows(replies: DataFrame, keys: list[str], user_col: str, text_col: str) -> DataFrame:
    """Two history rows per message of a signed-in user: the user's text
    and the rendered reply."""
    signed_in = replies.where(F.col(user_col).isNotNull())
    both = F.array(
        F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col(text_col).alias("message")),
        F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.col("reply").alias("message")))
    measured = ["matched", "metric_source", *METRICS]
    return signed_in.select(*keys, user_col, *measured, F.explode(both).alias("_r")).select(
        *keys, user_col, F.col("_r.k").alias("reply_order"), F.col("_r.role").alias("role"),
        F.col("_r.message").alias("message"), *measured)


def run_tagging_stream(spark: SparkSession, source_path: str, source_schema, sink_path: str,
                       checkpoint_path: str, lexicon: PreparedLexicon, truth: DataFrame,
                       keys: list[str], user_col: str, text_col: str,
                       message_filter=None, files_per_batch: int | None = None,
                       marks: dict[int, str] | None = None) -> None:
    """Process everything available in ``source_path`` (file stream,
    ``availableNow``), ``files_per_batch`` files at a time, and return when
    done."""
    reader = spark.readStream.schema(source_schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(source_path)
    if message_filter is not None:
        stream = stream.where(message_filter)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        replies = tag_messages(batch, lexicon, truth, keys, user_col, text_col, marks)
        rows = history_rows(replies, keys, user_col, text_col)
        rows.write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")

    q = (stream.writeStream.foreachBatch(each_batch)
         .option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()
