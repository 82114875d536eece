"""Training-corpus pipeline over ``documents``: STAGES of (name, function).

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. Stages, in order:

1. quality: the ordinal classifier, fitted on the ratings of ``labels``;
   documents that it rejects go.
2. near_duplicates: the n-gram Jaccard join; of each group one document stays,
   that with the smallest id.
3. substring_dedup: words in passages that an earlier document also has go;
   texts without any stay as they are, byte for byte. ``n_chars`` follows.
4. decontaminate: documents into which a benchmark item leaks go.
5. bpe: ids of every text, and the digest of the bytes they decode to."""

from __future__ import annotations

from pyspark.sql import functions as F

from langmix.llm import bpe, decontaminate, jaccard, quality, substring
from langmix.llm.common import land, table


def quality_stage(spark, docs, sf_dir):
    """Null texts, and texts without words, have the lowest grade and go."""
    return quality.select(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark, docs, sf_dir):
    return jaccard.distinct(docs)


def substring_stage(spark, docs, sf_dir):
    got = substring.dedup(docs)
    cut = F.col("n_removed") > 0
    changed = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text")),
               "n_chars": F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
               if "n_chars" in docs.columns else None}
    return got.select(*[c if changed.get(c) is None else changed[c].alias(c) for c in docs.columns])


def decontaminate_stage(spark, docs, sf_dir):
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark, docs, sf_dir):
    import public_tokenizers as P

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    got = bpe.decode(bpe.encode(docs.select("doc_id", "text"), ranks, P.PATTERN).drop("text"), ranks, P.PATTERN)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("substring_dedup", substring_stage),
          ("decontaminate", decontaminate_stage), ("bpe", bpe_stage)]

#: The classifier, the tiling and the encoder have no SQL form; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply all stages to ``documents``, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = land(docs, f"pipeline-{name}")
    return docs
