"""Registered queries: each binds an operator to the driver tables.

Every query reads its tables whole (or data Spark derives from them); limits
appear only where the limit is the operator (prefix limits, capped sample,
seeded take, prefix take, preview, one user's history). Queries on scores use
the first six of the 64 embedding values as logits of two models. Integer outputs are ``bigint`` and
doubles are rounded to 6 digits so the oracle comparison is exact."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from langmix.functions import labels as L
from langmix.functions.text import normalize_text, prompt, strip_ws
from langmix.operators import cleaning, corpus, keyed, lookup, metrics, sampling, scoring
from langmix.operators.align import first_subwords
from langmix.operators.ordering import global_rank
from langmix.plans.common import (EVAL_K, EVAL_SEED, FALLBACK, KEEP_LANGS, LANG_TAGS, MARKS,
                                  HISTORY_USER, MATCHED, MODELS, PREFIX_K, PREFIX_LIMITS, SAMPLE_CAP,
                                  SAMPLE_FRACTION, SEED,
                                  STEP_SIZE, clean_doc_lines, corpus_sources, doc_lines, lookup_key,
                                  r6, scored_tokens, table)

# ---------------------------------------------------------------- corpus -----


def corpus_union_dedup(spark, sf):
    u = corpus.union_distinct(corpus_sources(spark, sf))
    return corpus.with_sentence_id(u).select(
        "sentence_id", "sentence", F.col("first_source").cast("long").alias("first_source"))


def corpus_label_filter(spark, sf):
    docs = corpus.label_filter(table(spark, sf, "documents"), "lang", KEEP_LANGS)
    return docs.where(F.col("text").isNotNull()).select(
        "doc_id", "lang", strip_ws("text").alias("sentence"))


def corpus_source_contribution(spark, sf):
    c = corpus.source_contribution(corpus_sources(spark, sf))
    return c.select(F.col("source_rank").cast("long"), "source", "n_items", "n_new", "cum_unique")


def corpus_sorted_rank(spark, sf):
    return corpus.sorted_unique(corpus_sources(spark, sf)).select(
        F.col("rank").cast("long").alias("rank"), "sentence")


def corpus_lines(spark, sf):
    return doc_lines(spark, sf).select("doc_id", "line_no", "line")


def clean_documents(spark, sf):
    return clean_doc_lines(spark, sf).select("doc_id", "line_no", "text")


def clean_pages(spark, sf):
    pages = corpus.lines(table(spark, sf, "pages"), "html", ["page_id"])
    return cleaning.clean_lines(pages, "line", ["page_id", "line_no"]).select(
        "page_id", F.col("line_no").cast("long").alias("line_no"), "text")


def normalize_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", normalize_text("text").alias("norm_text"))


def normalize_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", normalize_text("html").alias("norm_text"))


def tokenize_counts(spark, sf):
    return cleaning.token_counts(clean_doc_lines(spark, sf), "text", ["doc_id"], squeezed=True)


def label_map(spark, sf):
    docs = table(spark, sf, "documents")
    tag = F.element_at(F.create_map(*[x for k, v in LANG_TAGS.items() for x in (F.lit(k), F.lit(v))]),
                       F.col("lang"))
    lid = L.label_id(tag)
    return docs.select("doc_id", "lang", tag.alias("tag"), lid.cast("long").alias("label_id"),
                       L.label_name(lid).alias("label"), L.label_display(lid).alias("display"))


def prompt_prefix(spark, sf):
    conv = table(spark, sf, "conversations")
    return conv.select("conv_id", "turn", prompt(normalize_text("text")).alias("prompt"))


def prefix_limits(spark, sf):
    docs, conv, bench = corpus_sources(spark, sf, with_pos=True)
    items = docs.unionByName(conv).unionByName(bench)
    return corpus.prefix_limit(items, PREFIX_LIMITS).select("source", "pos", "text")


def sample_capped(spark, sf):
    return corpus.capped_sample(corpus_sources(spark, sf), SAMPLE_CAP, SEED)


def sample_fraction(spark, sf):
    docs, conv, bench = corpus_sources(spark, sf)
    items = docs.unionByName(conv).unionByName(bench).where(F.col("text").isNotNull())
    items = items.select("source", strip_ws("text").alias("sentence"))
    got = corpus.fraction_sample(items, SAMPLE_FRACTION, SEED)
    return got.groupBy("source", "sentence").agg(F.count(F.lit(1)).alias("n"))


def _doc_split(spark, sf):
    return sampling.hash_split(table(spark, sf, "documents").select("doc_id"), ["doc_id"], SEED, 0.1)


def split_train_test(spark, sf):
    return _doc_split(spark, sf)


def eval_subset(spark, sf):
    test = _doc_split(spark, sf).where(F.col("split") == "test").select("doc_id")
    return sampling.seeded_take(test, ["doc_id"], EVAL_K, EVAL_SEED, "pick").select(
        "doc_id", F.col("pick").cast("long"))


def prefix_take(spark, sf):
    train = (_doc_split(spark, sf).where(F.col("split") == "train")
             .withColumn("_h", sampling.seeded_hash(["doc_id"], SEED)))
    top = sampling.prefix_take(train, ["_h", "doc_id"], PREFIX_K)
    return top.select("doc_id", F.row_number().over(Window.orderBy("_h", "doc_id"))
                      .cast("long").alias("pick"))


def zip_join(spark, sf):
    texts = global_rank(table(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"], "_r")
    texts = texts.select((F.col("_r") - 1).alias("pos"), "doc_id", "lang")
    labs = global_rank(table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"], "_r")
    labs = labs.select((F.col("_r") - 1).alias("pos"), F.col("doc_id").alias("label_doc_id"),
                       F.col("quality").cast("long").alias("quality"))
    return texts.join(labs, "pos").select("pos", "doc_id", "lang", "label_doc_id", "quality")


def lookup_last_wins(spark, sf):
    docs = table(spark, sf, "documents")
    # texts become digests before anything moves; numeric-only buffers keep last-wins a hash aggregation
    keyed = lookup.with_digest(docs.select("doc_id", lookup_key("text").alias("key")), "key").drop("key")
    truth = table(spark, sf, "labels").join(keyed, "doc_id").select("hi", "lo", F.col("doc_id").alias("truth_seq"), "quality", "toxic")
    last = lookup.last_of(truth, "truth_seq", ["quality", "toxic"])
    j = lookup.look_up(docs.select("doc_id", normalize_text("text").alias("key")), "key", last, ["truth_seq", "quality", "toxic"])
    return j.select("doc_id", F.col("truth_seq").isNotNull().alias("matched"), "truth_seq",
                    F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))


def chat_history(spark, sf):
    h = keyed.history(table(spark, sf, "conversations"), "conv_id", "turn")
    return h.select("conv_id", "turn", "role", F.col("recency").cast("long"))


def history_one_user(spark, sf):
    h = keyed.history(table(spark, sf, "conversations"), "conv_id", "turn", user=HISTORY_USER)
    return h.select("turn", "role", "text", F.col("recency").cast("long"))


def clean_injected(spark, sf):
    """Shapes the tables don't hold, put before or after every document's first
    line by fixed rule: dates, clock times, camelCase, ellipses, a null."""
    first = doc_lines(spark, sf).where("line_no = 0")
    k = F.col("doc_id") % 5
    line = (F.when(k == 0, F.concat(F.lit("(08/06/2021) "), "line")).when(k == 1, F.concat(F.lit("[4:14 petang] "), "line"))
            .when(k == 2, F.concat(F.lit("ReleaseThe "), F.split("line", " ")[0])).when(k == 3, F.concat("line", F.lit("...ok"))))
    return cleaning.clean_lines(first.select("doc_id", line.alias("line")), "line", ["doc_id"])


def _customers_incoming(spark, sf):
    cust = table(spark, sf, "customer")
    inc1 = cust.where(F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD")).select(
        "c_custkey", F.upper("c_name").alias("c_name"), "c_mktsegment",
        (F.col("c_custkey") * 2).alias("seq"))
    inc2 = cust.where(F.col("c_mktsegment") == "HOUSEHOLD").select(
        "c_custkey", F.lower("c_name").alias("c_name"), F.lit("FURNITURE").alias("c_mktsegment"),
        (F.col("c_custkey") * 2 + 1).alias("seq"))
    return cust, inc1.unionByName(inc2)


def insert_if_absent(spark, sf):
    cust, incoming = _customers_incoming(spark, sf)
    base = cust.where(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY")).select(
        "c_custkey", "c_name", "c_mktsegment")
    return keyed.insert_if_absent(base, incoming, ["c_custkey"], "seq")


def rows_exist(spark, sf):
    cust, incoming = _customers_incoming(spark, sf)
    return keyed.rows_exist(cust, incoming, ["c_custkey", "c_mktsegment"]).select(
        "c_custkey", "c_mktsegment")


# ---------------------------------------------------------------- scores -----


def softmax_argmax(spark, sf):
    s = scored_tokens(spark, sf)
    from langmix.functions.arrays import softmax
    p = softmax("logits")
    return s.select("model", "vec_id", *[r6(F.get(p, i)).alias(f"p{i}") for i in range(3)],
                    F.col("y_pred").cast("long"), r6("conf").alias("conf"))


def _first_word_conf(spark, sf):
    s = scored_tokens(spark, sf)
    s = s.withColumn("word_idx", F.when(F.col("pos") == 0, F.lit(None))
                     .otherwise(F.expr("(pos - 1) div 2")))
    keys = ["model", "sentence_id"]
    words = first_subwords(s, keys, "pos", "word_idx")
    return s, scoring.mean_confidence(words, s.select(*keys).distinct(), keys)


def confidence_mean(spark, sf):
    _, m = _first_word_conf(spark, sf)
    return m.select("model", "sentence_id", "n_words", r6("mean_conf").alias("mean_conf"))


def confidence_proxy(spark, sf):
    _, m = _first_word_conf(spark, sf)
    p = scoring.confidence_proxy("mean_conf")
    return m.select("model", "sentence_id", r6("mean_conf").alias("mean_conf"),
                    *[r6(p[k]).alias(k) for k in ("accuracy", "precision", "recall", "f1")])


def _model_counts(spark, sf):
    return metrics.cells(scored_tokens(spark, sf), ["model"])


def confusion_matrix(spark, sf):
    counts = metrics.confusion_counts(scored_tokens(spark, sf), ["model"])
    return metrics.confusion_long(counts, ["model"]).select(
        "model", F.col("y_true").cast("long"), F.col("y_pred").cast("long"), F.col("n").cast("long"))


def _round_prf(df, keys):
    return df.select(*keys, "n_tokens", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def accuracy(spark, sf):
    m = metrics.prf(_model_counts(spark, sf), ["model"], "macro")
    return m.select("model", "n_tokens", r6("accuracy").alias("accuracy"))


def macro_prf(spark, sf):
    return _round_prf(metrics.prf(_model_counts(spark, sf), ["model"], "macro"), ["model"])


def _sentence_weighted(spark, sf):
    counts = metrics.cells(scored_tokens(spark, sf), ["model", "sentence_id"])
    return metrics.prf(counts, ["model", "sentence_id"], "weighted")


def open_class_prf(spark, sf):
    """Truths in four classes or missing, predictions in five or missing."""
    emb = table(spark, sf, "embeddings")
    t = emb.select(F.expr("vec_id div 100").alias("part"),
                   F.when(F.col("vec_id") % 11 != 0, F.col("label") % 4).alias("y_true"),
                   F.when(F.col("vec_id") % 13 != 0, F.col("label") % 5).alias("y_pred"))
    m = metrics.prf(metrics.cells(t, ["part"]), ["part"], "macro")
    return m.select("part", "n_tokens", "n_null_truth", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def weighted_sentence_prf(spark, sf):
    return _round_prf(_sentence_weighted(spark, sf), ["model", "sentence_id"])


def span_prf(spark, sf):
    sp = metrics.span_prf(scored_tokens(spark, sf), ["model"], ["sentence_id"])
    return sp.select("model", "n_true", "n_pred", "tp",
                     *[r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def model_comparison(spark, sf):
    m = metrics.prf(_model_counts(spark, sf), ["model"], "macro")
    c = metrics.model_comparison(m, len(MODELS))
    return c.select("model", r6("f1_pct").alias("f1_pct"), r6("accuracy").alias("accuracy"), "all_present")


def best_by_metric(spark, sf):
    s = scored_tokens(spark, sf).withColumn("step", F.expr(f"(vec_id div {STEP_SIZE} + 1) * {STEP_SIZE}"))
    log = metrics.prf(metrics.cells(s, ["model", "step"]), ["model", "step"], "macro")
    log = log.where(F.col("f1").isNotNull()).withColumn("f1", r6("f1"))
    b = metrics.best_by(log, ["model"], "step", "f1")
    return b.select("model", F.col("best_step").cast("long"), "best_f1")


def metric_select(spark, sf):
    _, conf = _first_word_conf(spark, sf)
    w = _sentence_weighted(spark, sf)
    has_truth = table(spark, sf, "labels").select(F.col("doc_id").alias("sentence_id")).distinct()
    j = (conf.join(has_truth.withColumn("_t", F.lit(True)), "sentence_id", "left")
         .join(w.drop("n_tokens", "n_null_truth"), ["model", "sentence_id"], "left"))
    proxy = scoring.confidence_proxy("mean_conf")
    matched = F.coalesce(F.col("_t"), F.lit(False))
    return j.select(
        "model", "sentence_id",
        F.when(matched, F.lit(MATCHED)).otherwise(F.lit(FALLBACK)).alias("metric_source"),
        *[r6(F.when(matched, F.col(k)).otherwise(proxy[k])).alias(k)
          for k in ("accuracy", "precision", "recall", "f1")])


QUERIES = {
    "corpus_union_dedup": corpus_union_dedup,
    "corpus_label_filter": corpus_label_filter,
    "corpus_source_contribution": corpus_source_contribution,
    "corpus_sorted_rank": corpus_sorted_rank,
    "corpus_lines": corpus_lines,
    "clean_documents": clean_documents,
    "clean_pages": clean_pages,
    "normalize_documents": normalize_documents,
    "normalize_pages": normalize_pages,
    "tokenize_counts": tokenize_counts,
    "label_map": label_map,
    "prompt_prefix": prompt_prefix,
    "prefix_limits": prefix_limits,
    "sample_capped": sample_capped,
    "sample_fraction": sample_fraction,
    "history_one_user": history_one_user,
    "clean_injected": clean_injected,
    "split_train_test": split_train_test,
    "eval_subset": eval_subset,
    "prefix_take": prefix_take,
    "zip_join": zip_join,
    "lookup_last_wins": lookup_last_wins,
    "chat_history": chat_history,
    "insert_if_absent": insert_if_absent,
    "rows_exist": rows_exist,
    "softmax_argmax": softmax_argmax,
    "confidence_mean": confidence_mean,
    "confidence_proxy": confidence_proxy,
    "confusion_matrix": confusion_matrix,
    "accuracy": accuracy,
    "macro_prf": macro_prf,
    "weighted_sentence_prf": weighted_sentence_prf,
    "open_class_prf": open_class_prf,
    "span_prf": span_prf,
    "model_comparison": model_comparison,
    "best_by_metric": best_by_metric,
    "metric_select": metric_select,
}


# --------------------------------------------------------------- tagging -----

from langmix.functions import arrays as A  # noqa: E402
from langmix.operators import align as AL  # noqa: E402
from langmix.operators import profile as PR  # noqa: E402
from langmix.operators import tagging as TG  # noqa: E402
from langmix.plans.common import (StubEncoder, StubScorer, doc_languages, doc_lexicon, lexicon_from,  # noqa: E402
                                  tagged_doc_lines)

from langmix.session import stored  # noqa: E402

KEY_SCHEMA = "doc_id bigint, line_no bigint"
PARSE_NAMES = {0: "O", 1: "Malay", 2: "english"}


def _joined(c):
    return F.array_join(F.col(c).cast("array<string>") if isinstance(c, str) else c.cast("array<string>"),
                        " ", "N")


def lexicon(spark, sf):
    return doc_lexicon(spark, sf).select("token", "lang", "n", "total")


def tag_tokens(spark, sf):
    t = tagged_doc_lines(spark, sf)
    return t.select("doc_id", "line_no", _joined("tokens").alias("tokens"),
                    _joined("ner_tags").alias("ner_tags"), F.size("tokens").cast("long").alias("n_tokens"))


def label_distribution(spark, sf):
    d = PR.label_distribution(tagged_doc_lines(spark, sf), ["source"], "ner_tags")
    return d.select("source", F.col("label_id").cast("long"), "n", r6("share").alias("share"))


def sentence_profile(spark, sf):
    t = tagged_doc_lines(spark, sf)
    p = PR.sentence_profile("ner_tags")
    return t.select("doc_id", "line_no", *[p[k].cast("long").alias(k) for k in ("n_o", "n_ms", "n_en")],
                    p["code_switched"].alias("code_switched"),
                    p["switch_points"].cast("long").alias("switch_points"))


def paired_sequences_prf(spark, sf):
    """Tags of a line against tags of its normalized text, which has fewer
    tokens: paired by position, and aligned."""
    clean = stored(clean_doc_lines(spark, sf))
    lex = TG.PreparedLexicon(lexicon_from(clean, doc_languages(spark, sf)), LANG_TAGS)
    truth = TG.tag_lines(clean, lex, ["doc_id", "line_no", "source", "text"], "text", squeezed=True)
    truth = truth.select("doc_id", "line_no", "source", F.col("tokens").alias("words"), F.col("ner_tags").alias("truth"),
                         normalize_text("text").alias("norm"))
    both = TG.tag_lines(truth, lex, truth.columns, "norm", keep_empty=True)
    both = stored(both.select("source", "words", "truth", "ner_tags"))   # two modes read it
    pairs = [metrics.pair_sequences(both, ["source"], "truth", "ner_tags", mode, "words").withColumn("mode", F.lit(mode))
             for mode in ("positional", "aligned")]
    m = metrics.prf(metrics.cells(pairs[0].unionByName(pairs[1]), ["mode", "source"]), ["mode", "source"], "weighted")
    return _round_prf(m, ["mode", "source"])


def parse_tagged(spark, sf):
    t = tagged_doc_lines(spark, sf)
    decoded = L.format_tagged("tokens", "ner_tags", PARSE_NAMES)
    p = t.select("doc_id", "line_no", L.parse_tagged(decoded).alias("parsed"))   # parsed once, read three times
    return p.select("doc_id", "line_no", _joined("parsed.token").alias("tokens"),
                    _joined("parsed.label_id").alias("labels"), F.size("parsed").cast("long").alias("n"))


def annotate_text(spark, sf):
    t = tagged_doc_lines(spark, sf)
    return t.select("doc_id", "line_no", L.annotate("tokens", "ner_tags", MARKS).alias("annotated"))


ALIGNED = {"word_ids": (None, None), "labels": (L.IGNORE_INDEX, L.IGNORE_INDEX)}
ENCODED = {"input_ids": (101, 102), **ALIGNED}


def _aligned(spark, sf):
    t = tagged_doc_lines(spark, sf)
    w = AL.piece_word_ids("tokens")
    a = t.select("doc_id", "line_no", "ner_tags", w.alias("word_ids")).withColumn(
        "labels", AL.align_labels("word_ids", "ner_tags"))
    return AL.windows(a, ALIGNED)


def align_array(spark, sf):
    a = _aligned(spark, sf)
    return a.select("doc_id", "line_no", "window_no", _joined("word_ids").alias("word_ids"),
                    _joined("labels").alias("labels"), F.size("word_ids").cast("long").alias("n_sub"))


def align_long(spark, sf):
    rows = _aligned(spark, sf).select(
        "doc_id", "line_no", "window_no",
        F.posexplode(F.arrays_zip(F.col("word_ids").alias("w"), F.col("labels").alias("y"))).alias("sub_pos", "z"))
    return rows.select("doc_id", "line_no", "window_no", F.col("sub_pos").cast("long"),
                       F.col("z.w").cast("long").alias("word_idx"), F.col("z.y").cast("long").alias("label"))


def align_stored(spark, sf):
    """The long form of the walk, over sub-word rows and word labels stored apart."""
    t = tagged_doc_lines(spark, sf)
    # numbers only: they take a small part of the tokens' place
    t = stored(t.select("doc_id", "line_no", AL.piece_word_ids("tokens").alias("word_ids"), "ner_tags"))
    sub = t.select("doc_id", "line_no", F.posexplode("word_ids").alias("sub_pos", "word_idx"))
    words = t.select("doc_id", "line_no", F.posexplode("ner_tags").alias("word_idx", "label"))
    out = AL.align_long(sub, words, ["doc_id", "line_no"])
    return out.select("doc_id", "line_no", F.col("sub_pos").cast("long"),
                      F.col("word_idx").cast("long"), F.col("label").cast("long"))


def model_udf_tagger(spark, sf):
    clean = clean_doc_lines(spark, sf)
    t = TG.model_tag_lines(clean, ["doc_id", "line_no"], "text", scoring.backend("word-stub"), KEY_SCHEMA)
    return t.select("doc_id", "line_no", _joined("tokens").alias("tokens"), _joined("ner_tags").alias("ner_tags"))


def _encoded(spark, sf):
    enc = AL.encode_batches(tagged_doc_lines(spark, sf), "tokens", StubEncoder)
    return AL.windows(enc.withColumn("labels", AL.align_labels("word_ids", "ner_tags")), ENCODED)


def encode_udf(spark, sf):
    e = _encoded(spark, sf)
    return e.select("doc_id", "line_no", "window_no", _joined("input_ids").alias("input_ids"),
                    _joined("word_ids").alias("word_ids"), _joined("labels").alias("labels"))


def score_udf(spark, sf):
    e = _encoded(spark, sf).select("doc_id", "line_no", "window_no", "input_ids", "labels")
    s = scoring.score_batches(e, "input_ids", StubScorer)
    rows = s.select("doc_id", "line_no", "window_no", F.posexplode(F.arrays_zip("logits", "labels")).alias("pos", "z")) \
        .where(F.col("z.labels") != L.IGNORE_INDEX)
    return rows.select("doc_id", "line_no", "window_no", F.col("pos").cast("long").alias("sub_pos"),
                       F.col("z.labels").cast("long").alias("y_true"),
                       A.argmax("z.logits").cast("long").alias("y_pred"),
                       r6(A.max_prob("z.logits")).alias("conf"))


QUERIES.update({
    "lexicon": lexicon,
    "tag_tokens": tag_tokens,
    "label_distribution": label_distribution,
    "sentence_profile": sentence_profile,
    "paired_sequences_prf": paired_sequences_prf,
    "parse_tagged": parse_tagged,
    "annotate_text": annotate_text,
    "align_array": align_array,
    "align_long": align_long,
    "align_stored": align_stored,
    "model_udf_tagger": model_udf_tagger,
    "encode_udf": encode_udf,
    "score_udf": score_udf,
})


def sequence_confidence(spark, sf):
    s = scored_tokens(spark, sf)
    c = scoring.sequence_confidence(s, s.select("model", "sentence_id").distinct(), ["model", "sentence_id"])
    return c.select("model", "sentence_id", F.col("n_words").alias("n_steps"), r6("mean_conf").alias("mean_conf"))


QUERIES["sequence_confidence"] = sequence_confidence
