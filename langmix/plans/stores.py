"""Registered queries on stored state and routed models: each writes data
derived from the driver tables to a fresh folder, as the rules on stand-in
input in ``files.py``, and reads back what the library made of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from langmix.functions.text import normalize_text
from langmix.operators import metrics, ordering, routing, sampling, scoring, tagging
from langmix.plans import oracle as O
from langmix.plans.common import (LANG_TAGS, SEED, StubEncoder, StubScorer, clean_doc_lines, doc_languages, r6, scored_tokens,
                                  table)
from langmix.plans.queries import _customers_incoming
from langmix.functions.text import split_squeezed
from langmix.session import scratch_path, stored
from langmix.sources import readers, sinks, store

# --- Fixed values (stand-in models) --------------------------------------------
CLASSIFIER, SEQUENCE = "classifier-stub-routed", "sequence-stub-routed"
NAMES = ("other", "Malay", "English")   # of a token's length modulo 3
BASE_SEGMENTS = ("BUILDING", "AUTOMOBILE", "MACHINERY")
TEST_SHARE = 0.1
FIRST_ITEMS = 3
# -------------------------------------------------------------------------------


class RoutedClassifier:
    """Deterministic stand-in for an encoder with its token classifier."""

    def __init__(self):
        self.encode, self.score = StubEncoder(), StubScorer()

    def __call__(self, sentences):
        ids, words = self.encode(sentences)
        return [([None if x < 0 else x for x in w.tolist()], s.tolist()) for w, s in zip(words, self.score(ids))]


class RoutedSequence:
    """Deterministic stand-in for a sequence model: echoes the prompt's task
    word, names each token by its length, one step a token."""

    def __call__(self, prompts):
        out = []
        for p in prompts:
            tokens = p.split(" ")[1:]
            items = [f"[{t}] -> {NAMES[len(t) % 3]}" for t in tokens]
            steps = [[round(len(t) % k / k, 6) for k in (3, 5, 7)] for t in tokens]
            out.append((" | ".join(items), steps))
        return out


scoring.register_backend(CLASSIFIER, RoutedClassifier, "classifier")
scoring.register_backend(SEQUENCE, RoutedSequence, "sequence")


def routed_predictions(spark, sf):
    """Every turn tagged by the model that its conversation names."""
    conv = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, CLASSIFIER).otherwise(SEQUENCE).alias("model"),
        normalize_text("text").alias("text"))
    got = routing.predict(conv, "model", "text")
    p = scoring.confidence_proxy("mean_conf")
    return got.select("conv_id", "turn", "model", F.array_join("tokens", " ").alias("tokens"),
                      F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"),
                      r6("mean_conf").alias("mean_conf"), *[r6(p[k]).alias(k) for k in ("accuracy", "precision", "recall", "f1")])


def append_numbered(spark, sf):
    """Two batches appended, the first one once more, and the table read back."""
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    path = scratch_path(spark, "history")
    for batch, rows in (("user", conv.where("role = 'user'")), ("rest", conv.where("role <> 'user'")),
                        ("user", conv.where("role = 'user'"))):
        store.append_numbered(rows, path, batch, ["conv_id", "turn"])
    return store.read_numbered(spark, path).select("id", "conv_id", "turn", "role")


def merge_stored(spark, sf):
    """Customers inserted into a stored table where absent, in two merges, and
    the table read back."""
    cust, incoming = _customers_incoming(spark, sf)
    keyed = store.KeyedTable(spark, scratch_path(spark, "customers"), ["c_custkey"])
    keyed.create(cust.where(F.col("c_mktsegment").isin(*BASE_SEGMENTS)).select("c_custkey", "c_name", "c_mktsegment"))
    keyed.merge(incoming, "seq")
    keyed.merge(incoming, "seq")   # nothing is new any more
    return keyed.read()


def cache_states(spark, sf):
    """One cache asked for five times: made, reused, asked with another seed,
    broken off (its manifest gone), and reused again."""
    docs = f"{sf.rstrip('/')}/documents.parquet"
    path = scratch_path(spark, "cache")
    rows = []
    for turn, (seed, broken) in enumerate([(SEED, False), (SEED, False), (SEED + 1, False), (SEED + 1, True), (SEED + 1, False)]):
        if broken:
            sinks.forget(spark, path)
        action, folder = sinks.cached_split(
            spark, path, [docs], {"seed": seed, "test": TEST_SHARE},
            lambda seed=seed: sampling.hash_split(spark.read.parquet(docs).select("doc_id"), ["doc_id"], seed, TEST_SHARE))
        rows.append(spark.read.parquet(folder).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
                    .select(F.lit(turn + 1).cast("long").alias("turn"), F.lit(action).alias("action"), "split", "n", "first_id"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def lexicon_merged(spark, sf):
    """Counts of two parts of the corpus, stored one after the other; the
    lexicon of their sum."""
    clean = stored(clean_doc_lines(spark, sf))
    path = scratch_path(spark, "token-counts")
    for part in (0, 1):
        lines = clean.where(F.col("doc_id") % 2 == part)
        counts = tagging.token_counts(lines.select(F.explode(split_squeezed(F.lower("text"))).alias("token"), "lang"))
        sinks.append_rows(counts, path)
    total = tagging.add_counts(spark.read.parquet(path))
    return tagging.lexicon_of(total, languages=doc_languages(spark, sf)).select("token", "lang", "n", "total")


def paired_stored(spark, sf):
    """Predictions and truths stored apart, in buckets by sentence, and paired
    without an exchange; sentences with one side only are counted."""
    s = scored_tokens(spark, sf)
    rows = s.groupBy("sentence_id", "model").agg(F.array_sort(F.collect_list(F.struct("pos", "y_true", "y_pred"))).alias("r"))
    rows = stored(rows.select("sentence_id", "model", F.transform("r", lambda x: x["y_true"]).alias("truth"),
                                   F.transform("r", lambda x: x["y_pred"]).alias("pred")))
    truth = rows.where("model = 'A' AND sentence_id % 7 <> 3").select("sentence_id", "truth")
    pred = rows.where("sentence_id % 5 <> 4").select("sentence_id", "model", F.slice("pred", 1, 8).alias("pred"))
    sides = [metrics.store_side(df, "sentence_id", scratch_path(spark, name)) for df, name in ((truth, "truths"), (pred, "predictions"))]
    return metrics.pair_stored(*sides, "sentence_id", "model").select(
        "model", "n_sentences", "n_no_truth", "n_tokens", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def hot_user_history(spark, sf):
    """Newest-first places of a history in which one user has a third of all
    rows: ranked over many tasks, no window per user."""
    conv = table(spark, sf, "conversations").select(
        F.when(F.col("conv_id") % 3 == 0, F.lit(0)).otherwise(F.col("conv_id")).alias("user"), "conv_id", "turn")
    got = ordering.grouped_rank(conv, ["user"], [F.col("conv_id").desc(), F.col("turn").desc()], "recency")
    return got.select("user", "conv_id", "turn", F.col("recency").cast("long"))


def json_first_items(spark, sf):
    """The first items of every document's array, and of two parallel arrays."""
    docs = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("x"))
    value = F.to_json(F.struct("doc_id", F.col("x").alias("words"), F.transform("x", lambda w: F.length(w).cast("string")).alias("sizes")))
    rows = docs.select(value.alias("j"))
    one = readers.json_array_items(rows, "j", "words", extra_schema="doc_id bigint", max_items=FIRST_ITEMS)
    two = readers.json_pairs(rows, "j", "words", "sizes", max_items=FIRST_ITEMS - 1)
    counted = two.groupBy("text", "label").agg(F.count(F.lit(1)).alias("n"))
    return one.select("doc_id", "pos", "text", F.lit(None).cast("string").alias("label"), F.lit(1).cast("long").alias("n")).unionByName(
        counted.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("pos"), "text", "label", "n"))


QUERIES = {
    "hot_user_history": hot_user_history,
    "json_first_items": json_first_items,
    "routed_predictions": routed_predictions,
    "append_numbered": append_numbered,
    "merge_stored": merge_stored,
    "cache_states": cache_states,
    "lexicon_merged": lexicon_merged,
    "paired_stored": paired_stored,
}

# ----------------------------------------------------------------- oracle ----

SQL = {}

SQL["routed_predictions"] = f"""WITH t AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN '{CLASSIFIER}' ELSE '{SEQUENCE}' END AS model,
    conv_id % 2 = 0 AS c, {O.split_ws(O.normalize('text'))} AS toks FROM conversations),
p AS (SELECT conv_id, turn, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok, c FROM t),
l AS (SELECT *, CASE WHEN c THEN [round((unicode(tok) % 7) / 7.0, 6), round((unicode(tok) % 11) / 11.0, 6), round((unicode(tok) % 13) / 13.0, 6)]
  ELSE [round((length(tok) % 3) / 3.0, 6), round((length(tok) % 5) / 5.0, 6), round((length(tok) % 7) / 7.0, 6)] END AS g FROM p),
m AS (SELECT conv_id, turn, avg(conf) AS conf FROM (SELECT *, 1 / list_sum(list_transform(g, lambda x: exp(x - list_max(g)))) AS conf
  FROM (SELECT * FROM l UNION ALL SELECT conv_id, turn, 0, 'tag', c, [0.0, 0.6, round(3 / 7.0, 6)] FROM t WHERE NOT c)) GROUP BY ALL),
a AS (SELECT conv_id, turn, string_agg(tok, ' ' ORDER BY pos) AS tokens,
  string_agg(CASE WHEN c THEN list_position(g, list_max(g)) - 1 ELSE length(tok) % 3 END, ' ' ORDER BY pos) AS labels
  FROM l WHERE c OR lower(tok) <> 'tag' GROUP BY conv_id, turn)
SELECT conv_id, turn, model, coalesce(tokens, '') AS tokens, coalesce(labels, '') AS labels, {O.r6('coalesce(conf, 0.8)')} AS mean_conf,
  {O.proxy_cols('coalesce(conf, 0.8)')}
FROM t LEFT JOIN m USING (conv_id, turn) LEFT JOIN a USING (conv_id, turn)"""

SQL["hot_user_history"] = """SELECT u AS user, conv_id, turn,
  (row_number() OVER (PARTITION BY u ORDER BY conv_id DESC, turn DESC))::BIGINT AS recency
FROM (SELECT CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS u, conv_id, turn FROM conversations)"""

SQL["json_first_items"] = f"""WITH w AS (SELECT doc_id, string_split(text, ' ') AS x FROM documents),
p AS (SELECT doc_id, (generate_subscripts(x, 1) - 1)::BIGINT AS pos, unnest(x) AS text FROM w)
SELECT doc_id, pos, text, NULL::VARCHAR AS label, 1::BIGINT AS n FROM p WHERE pos < {FIRST_ITEMS}
UNION ALL SELECT NULL, NULL, text, length(text)::VARCHAR, count(*)::BIGINT FROM p WHERE pos < {FIRST_ITEMS - 1} GROUP BY text"""

SQL["append_numbered"] = """SELECT (row_number() OVER (ORDER BY role <> 'user', conv_id, turn))::BIGINT AS id, conv_id, turn, role
FROM conversations"""

SQL["merge_stored"] = f"""SELECT c_custkey, c_name, c_mktsegment FROM ({O.SQL['insert_if_absent']})"""

_SPLIT = f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {{h}}, doc_id) <= ceil({TEST_SHARE} * count(*) OVER ())
  THEN 'test' ELSE 'train' END AS split FROM documents"""
SQL["cache_states"] = f"""WITH s AS (SELECT {SEED} AS seed, * FROM ({_SPLIT.format(h=O.h('doc_id', SEED))})
  UNION ALL SELECT {SEED + 1}, * FROM ({_SPLIT.format(h=O.h('doc_id', SEED + 1))})),
t(turn, seed, action) AS (VALUES (1, {SEED}, 'built'), (2, {SEED}, 'reused'), (3, {SEED + 1}, 'built'), (4, {SEED + 1}, 'built'),
  (5, {SEED + 1}, 'reused'))
SELECT turn::BIGINT AS turn, action, split, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM t JOIN s USING (seed) GROUP BY ALL"""

SQL["lexicon_merged"] = O.SQL["lexicon"]

SQL["paired_stored"] = f"""WITH {O.SCORED_CTE},
truth AS (SELECT sentence_id, pos, y_true FROM scored WHERE model = 'A' AND sentence_id % 7 <> 3),
pred AS (SELECT model, sentence_id, pos, y_pred FROM scored WHERE sentence_id % 5 <> 4 AND pos < 8),
pairs AS (SELECT model, y_true, y_pred FROM pred JOIN truth USING (sentence_id, pos) WHERE y_true <> -100),
counted AS (SELECT model, {O.COUNTS_SELECT} FROM pairs GROUP BY model),
m AS (SELECT model, {O.prf_select('weighted')} FROM counted),
n AS (SELECT model, count(DISTINCT sentence_id)::BIGINT AS n_sentences,
  count(DISTINCT CASE WHEN sentence_id % 7 = 3 THEN sentence_id END)::BIGINT AS n_no_truth FROM pred GROUP BY model)
SELECT model, n_sentences, n_no_truth, n_tokens, accuracy, precision, recall, f1 FROM n LEFT JOIN m USING (model)"""
