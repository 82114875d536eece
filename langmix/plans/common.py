"""Bindings shared by the registered queries: table loading, the document
line/clean/tag chain and the scored-token table built from ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.functions.arrays import argmax, max_prob
from langmix.functions.labels import IGNORE_INDEX
from langmix.functions.text import normalize_text, split_squeezed, split_ws
from langmix.operators import cleaning, corpus, tagging
from langmix.session import spread, stored

# --- Fixed values (binding parameters) ---------------------------------------
LANG_TAGS = {"en": "EN", "fr": "MS"}   # stand-ins for English / Malay
KEEP_LANGS = ("en", "fr")
SEED = 42
EVAL_SEED = 7
EVAL_K = 40
PREFIX_K = 500
PREFIX_LIMITS = {"documents": 400, "benchmark": 100, "conversations": 450}
SAMPLE_CAP = 500
SAMPLE_FRACTION = 0.25
HISTORY_USER = 7
SENTENCE_SIZE = 10       # embeddings rows per pseudo sentence
STEP_SIZE = 100          # embeddings rows per pseudo checkpoint evaluation
MODELS = ("A", "B")      # two logit slices of each embedding
DIGITS = 6
MATCHED, FALLBACK = "truth", "proxy"   # where a sentence's metrics come from
MARKS = {1: "<i lang=ms>{t}</i>", 2: "<i lang=en>{t}</i>"}   # rendered labels
# -----------------------------------------------------------------------------

DOC_KEYS = ["doc_id", "line_no"]


# text tables and their keys: spread over all cores when small (see session.spread)
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, DIGITS)


def doc_lines(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return (corpus.lines(docs, "text", ["doc_id", "lang", "source"])
            .withColumn("line_no", F.col("line_no").cast("long")))


def clean_doc_lines(spark, sf_dir) -> DataFrame:
    return cleaning.clean_lines(doc_lines(spark, sf_dir), "line",
                                ["doc_id", "lang", "source", "line_no"])


def doc_languages(spark, sf_dir) -> list[str] | None:
    """Language list of the documents (a pruned one-column scan, size-checked)."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return tagging.known_languages(docs, "lang")


def lexicon_from(clean: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Lexicon from cleaned (single-spaced) lines; each line is lowercased
    once before the split instead of each token after it."""
    return tagging.lexicon_of(tagging.line_token_counts(clean), languages=languages)


def doc_lexicon(spark, sf_dir) -> DataFrame:
    return lexicon_from(clean_doc_lines(spark, sf_dir), doc_languages(spark, sf_dir))


TAG_KEYS = DOC_KEYS + ["source"]


def tagged_doc_lines(spark, sf_dir) -> DataFrame:
    """``(doc_id, line_no, source, tokens, ner_tags)`` via the native lexicon."""
    # cleaned once, used twice (lexicon and tagging): checkpointed to the
    # shared folder so neither use recomputes the regex chain
    clean = stored(clean_doc_lines(spark, sf_dir))
    return tagging.tag_lines(clean, lexicon_from(clean, doc_languages(spark, sf_dir)), TAG_KEYS, "text",
                             LANG_TAGS, squeezed=True)


class StubTagger:
    """Deterministic stand-in for a word-language model: ASCII words -> EN,
    other alphabetic words -> MS, everything else -> O."""

    def __call__(self, tokens):
        return ["EN" if t.isascii() and t.isalpha() else "MS" if t.isalpha() else "O" for t in tokens]


class StubEncoder:
    """Deterministic stand-in for a sub-word tokenizer: 4-character pieces;
    id = code point of the piece's first character; 101/102 specials."""

    def __call__(self, sentences):
        import itertools

        import numpy as np

        sizes = np.fromiter(map(len, sentences), np.int64, len(sentences))
        tokens = [t or "\0" for t in itertools.chain.from_iterable(sentences)]
        chars = np.fromiter(map(len, tokens), np.int64, len(tokens))
        pieces = (chars + 3) // 4
        word = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)   # index in its sentence
        first = np.repeat(np.cumsum(chars) - chars - 4 * (np.cumsum(pieces) - pieces), pieces) + 4 * np.arange(pieces.sum())
        codes = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)[first].astype(np.int32)
        every = np.concatenate(([0], np.cumsum(pieces)))[np.cumsum(sizes)]   # pieces up to the end of each sentence
        cuts = np.concatenate(([0], every + 2 * np.arange(1, len(sizes) + 1)))
        ids, words = np.full(cuts[-1], 102, np.int32), np.full(cuts[-1], -1, np.int32)   # -1: no word
        ids[cuts[:-1]] = 101
        body = np.ones(len(ids), bool)
        body[cuts[:-1]] = body[cuts[1:] - 1] = False
        ids[body], words[body] = codes, np.repeat(word, pieces)
        cuts = cuts.tolist()
        return [[x[a:b] for a, b in zip(cuts, cuts[1:])] for x in (ids, words)]


class StubScorer:
    """Deterministic stand-in for a token classifier: three logits per id."""

    def __call__(self, batch):
        import numpy as np
        seqs = [np.asarray(seq, dtype=np.int64) for seq in batch]
        x = np.concatenate(seqs) if seqs else np.zeros(0, np.int64)
        scores = np.round(np.stack([(x % 7) / 7.0, (x % 11) / 11.0, (x % 13) / 13.0], axis=1), DIGITS)
        return np.split(scores, np.cumsum([len(s) for s in seqs])[:-1]) if seqs else []


def corpus_sources(spark, sf_dir, with_pos: bool = False) -> list[DataFrame]:
    docs = corpus.source_items(table(spark, sf_dir, "documents"), "text", "documents", 1, "doc_id")
    conv = table(spark, sf_dir, "conversations")
    if with_pos:
        from langmix.operators.ordering import global_rank
        conv = global_rank(conv.select("conv_id", "turn", "text"), ["conv_id", "turn"], "_r") \
            .withColumn("_p", F.col("_r") - 1)
        conv = corpus.source_items(conv, "text", "conversations", 2, "_p")
    else:
        conv = corpus.source_items(conv, "text", "conversations", 2)
    bench = corpus.source_items(table(spark, sf_dir, "benchmark"), "text", "benchmark", 3, "item_id")
    return [docs, conv, bench]


def lookup_key(text_col: str) -> F.Column:
    """Ground-truth key: normalize the space-joined tokens. Non-nullable, so
    the optimizer infers no ``isnotnull(key)`` filter (which would copy the
    whole regex chain below the join)."""
    return F.coalesce(normalize_text(F.array_join(split_ws(text_col), " ")), F.lit(""))


def scored_tokens(spark, sf_dir) -> DataFrame:
    """Token-classification stand-in: sentence = ``vec_id div 10``, position
    0 is a special position (ignore index), truth = ``label % 3``; model A
    scores with embedding values 1-3, model B with values 4-6."""
    emb = table(spark, sf_dir, "embeddings")
    models = F.array(*[
        F.struct(F.lit(m).alias("model"),
                 F.transform(F.slice("embedding", 1 + 3 * i, 3),
                             lambda x: F.round(x.cast("double"), DIGITS)).alias("logits"))
        for i, m in enumerate(MODELS)])
    pos = F.expr(f"vec_id % {SENTENCE_SIZE}")
    base = emb.select(
        "vec_id", F.expr(f"vec_id div {SENTENCE_SIZE}").alias("sentence_id"), pos.alias("pos"),
        F.when(pos == 0, F.lit(IGNORE_INDEX)).otherwise(F.col("label") % 3).cast("int").alias("y_true"),
        F.explode(models).alias("_m"))
    return base.select("vec_id", "sentence_id", "pos", "y_true", F.col("_m.model").alias("model"),
                       F.col("_m.logits").alias("logits"),
                       argmax("_m.logits").alias("y_pred"), max_prob("_m.logits").alias("conf"))


def _register_stubs():
    from langmix.operators.scoring import register_backend
    register_backend("word-stub", StubTagger)
    register_backend("subword-stub", StubEncoder)
    register_backend("classifier-stub", StubScorer)


_register_stubs()
