"""Registered queries that go through files: each writes data derived from
the driver tables to a fresh folder under the shared checkpoint location,
reads it back with our readers, and returns the result. Fault lines
(blank, malformed, non-string items) are injected by fixed rules on the
data so the readers' error paths are exercised on every run."""

from __future__ import annotations

from pyspark.sql import functions as F

from langmix.functions.labels import IGNORE_INDEX
from langmix.functions.text import split_lines, split_ws, strip_ws
from langmix.operators import corpus, profile, sampling
from langmix.operators.tagging import PreparedLexicon
from langmix.plans import oracle as O
from langmix.plans.common import (KEEP_LANGS, LANG_TAGS, MARKS, SEED, corpus_sources, doc_lexicon, r6, table,
                                  tagged_doc_lines)
from langmix.session import scratch_path, stored
from langmix.sources import readers, sinks
from langmix.sources.commit import listing
from langmix.streaming.tagging_stream import METRICS, run_tagging_stream

# --- Fixed values (fault injection and sizes) ---------------------------------
BLANK_EVERY, BLANK_AT = 13, 5      # blank line after doc_id % 13 == 5
BAD_EVERY, BAD_AT = 251, 250       # malformed line after doc_id % 251 == 250
NUMBER_EVERY, NULL_EVERY = 5, 7    # non-string array items
GUEST_EVERY, GUEST_AT = 5, 4       # conversations without a signed-in user
TRUTH_EVERY = 3                    # conversations whose user turns have labels
PREVIEW_N = 20
STREAM_BATCHES = 4                 # micro-batches of the backlog, whatever its size: each has a fixed cost and reads the truth
# -----------------------------------------------------------------------------


def _joined(c):
    return F.array_join(F.col(c).cast("array<string>"), " ", "N")


def json_array_keys(spark, sf):
    d = table(spark, sf, "documents")
    j = F.concat(F.lit('{"'), "source", F.lit('_X": ['), F.col("n_chars").cast("string"), F.lit('], "'),
                 "lang", F.lit('_Y":[1], "meta": {"n": '), F.col("n_chars").cast("string"),
                 F.lit('}, "text": "'), "text", F.lit('"}'))
    return profile.json_array_keys(d.select(j.alias("j")), "j")


def preview_jsonl(spark, sf):
    d = table(spark, sf, "documents")
    good = d.select("doc_id", F.lit(0).alias("kind"), F.concat(
        F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "lang": "'), "lang",
        F.lit('", "n_chars": '), F.col("n_chars").cast("string"), F.lit("}")).alias("line"))
    blank = d.where(F.col("doc_id") % BLANK_EVERY == BLANK_AT).select("doc_id", F.lit(1), F.lit(""))
    bad = d.where(F.col("doc_id") % BAD_EVERY == BAD_AT).select(
        "doc_id", F.lit(2), F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "lang": ')))
    path = scratch_path(spark, "preview")
    sinks.write_text(good.union(blank).union(bad), "line", path, ["doc_id", "kind"])
    lines = readers.lines_between(spark, path, 1, PREVIEW_N).select(F.col("global_line_no").alias("line_no"), "value")
    pv = profile.preview(lines, PREVIEW_N, pretty=True)
    return pv.select("line_no", "is_bad", F.variant_get("record", "$.doc_id", "bigint").alias("doc_id"),
                     F.variant_get("record", "$.lang", "string").alias("lang"),
                     "content")


def append_report(spark, sf):
    """Rows appended in two writes, then a report of the whole table, read back."""
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    rows, report = scratch_path(spark, "appended"), scratch_path(spark, "report")
    sinks.append_rows(conv.where("role = 'user'"), rows)
    sinks.append_rows(conv.where("role <> 'user'"), rows)
    sinks.write_report(spark.read.parquet(rows).groupBy("role").agg(F.count(F.lit(1)).alias("n"),
                                                                   F.max("turn").alias("last_turn")), report)
    return spark.read.parquet(report)


def optional_sources(spark, sf):
    """Three sources of which one is missing: skipped, and reported so."""
    found = []
    for name in ("documents", "no_such_table", "benchmark"):
        path = f"{sf.rstrip('/')}/{name}.parquet"
        df = readers.optional_source(spark, path, "text string", lambda p: spark.read.parquet(p).select("text"))
        found.append(df.agg(F.lit(name).alias("source"), F.lit(readers.path_exists(spark, path)).alias("present"),
                            F.count(F.lit(1)).alias("n")))
    return found[0].union(found[1]).union(found[2])


def _lookup_file(spark, sf):
    # three branches read it, and writing in order reads it more than once: made into text once
    t = stored(tagged_doc_lines(spark, sf).select("doc_id", "line_no", F.to_json(F.struct("tokens", "ner_tags")).alias("line")))
    good = t.select("doc_id", "line_no", F.lit(0).alias("kind"), "line")
    blank = t.where((F.col("doc_id") % BLANK_EVERY == BLANK_AT) & (F.col("line_no") == 0)).select(
        "doc_id", "line_no", F.lit(1), F.lit("   "))
    bad = t.where((F.col("doc_id") % BAD_EVERY == BAD_AT) & (F.col("line_no") == 0)).select(
        "doc_id", "line_no", F.lit(2), F.lit('{"tokens": ["broken"'))
    path = scratch_path(spark, "lookup")
    sinks.write_text(good.union(blank).union(bad), "line", path, ["doc_id", "line_no", "kind"])
    return path


def lookup_load(spark, sf):
    lk = readers.load_lookup(spark, _lookup_file(spark, sf))
    return lk.select("key", _joined("ner_tags").alias("ner_tags"), "seq")


def lookup_faults(spark, sf):
    faults = readers.line_faults(readers.judged_lines(spark, _lookup_file(spark, sf)))
    return faults.agg(*[F.sum(c).alias(c) for c in ("n_lines", "n_blank", "n_bad")])


def text_roundtrip(spark, sf):
    u = corpus.union_distinct(corpus_sources(spark, sf))
    path = scratch_path(spark, "sentences")
    sinks.write_text(u, "sentence", path, ["sentence"])
    back = spark.read.text(path)
    return back.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def jsonl_roundtrip(spark, sf):
    t = tagged_doc_lines(spark, sf)
    path = scratch_path(spark, "labelled")
    sinks.write_jsonl(t.select("tokens", "ner_tags"), path)
    # the labelled corpus is an optional source (missing -> empty) and must
    # not be empty before encoding (one-row probe)
    back = readers.optional_source(spark, path, readers.LABELLED_SCHEMA,
                                   lambda p: readers.read_labelled_jsonl(spark, p))
    readers.require_nonempty(back, "labelled corpus")
    return back.groupBy(_joined("tokens").alias("tokens"), _joined("ner_tags").alias("ner_tags")).agg(
        F.count(F.lit(1)).alias("n"))


def split_cache(spark, sf):
    from langmix.operators import align as AL
    t = tagged_doc_lines(spark, sf)
    w = AL.piece_word_ids("tokens")
    enc = t.select("doc_id", "line_no", w.alias("word_ids"), "ner_tags").withColumn(
        "labels", AL.align_labels("word_ids", "ner_tags")).drop("ner_tags")
    split = sampling.hash_split(enc, ["doc_id", "line_no"], SEED, 0.1, materialize_input=True)
    split = AL.windows(split, {"word_ids": (None, None), "labels": (IGNORE_INDEX, IGNORE_INDEX)})
    path = scratch_path(spark, "split-cache")
    sinks.write_split_cache(split, path)
    test = readers.read_split(spark, path, "test")
    return test.select("doc_id", "line_no", "window_no", F.size("word_ids").cast("long").alias("n_sub"),
                       F.size(F.filter("labels", lambda x: x != IGNORE_INDEX)).cast("long").alias("n_labelled"))


def _doc_json(d, with_labels: bool):
    lines = split_lines(strip_ws("text"))
    extra = F.concat(
        F.when(F.col("doc_id") % NUMBER_EVERY == 0, F.concat(F.lit(", "), F.col("n_chars").cast("string")))
        .otherwise(F.lit("")),
        F.when(F.col("doc_id") % NULL_EVERY == 0, F.lit(", null")).otherwise(F.lit("")))
    xs = F.to_json(lines)
    xs = F.concat(F.expr("substring(_xs, 1, length(_xs) - 1)"), extra, F.lit("]"))
    parts = [F.lit('{"doc": '), F.col("doc_id").cast("string"), F.lit(', "train_X": '), xs]
    if with_labels:
        labs = F.array_repeat("lang", F.size(lines) + (F.col("doc_id") % NUMBER_EVERY == 0).cast("int")
                              + (F.col("doc_id") % NULL_EVERY == 0).cast("int"))
        parts += [F.lit(', "train_Y": '), F.to_json(labs)]
    return d.withColumn("_xs", F.to_json(lines)).select("doc_id", F.concat(*parts, F.lit("}")).alias("j"))


def json_array_scan(spark, sf):
    d = table(spark, sf, "documents")
    path = scratch_path(spark, "json-docs")
    sinks.write_text(_doc_json(d, False), "j", path)
    docs = spark.read.text(path)
    items = readers.json_array_items(docs, "value", "train_X", extra_schema="doc bigint")
    return items.where("is_string").select(F.col("doc").alias("doc_id"), "pos",
                                           strip_ws("text").alias("sentence"))


def parallel_json_scan(spark, sf):
    d = table(spark, sf, "documents")
    path = scratch_path(spark, "json-parallel")
    sinks.write_text(_doc_json(d, True), "j", path)
    pairs = readers.json_pairs(spark.read.text(path), "value", "train_X", "train_Y")
    kept = corpus.label_filter(pairs.where("is_string"), "label", KEEP_LANGS)
    return kept.select(strip_ws("text").alias("sentence")).distinct()


def stream_messages(spark, sf):
    """Conversation turns as requests; every fifth conversation is a guest's."""
    conv = table(spark, sf, "conversations")
    return conv.withColumn("username", F.when(F.col("conv_id") % GUEST_EVERY != GUEST_AT,
                                              F.concat(F.lit("u"), F.col("conv_id").cast("string"))))


def stream_truth(spark, sf):
    """Look-up by digest, read from a labelled file: user turns of every third
    conversation, with the length of a token modulo 3 as its label."""
    conv = table(spark, sf, "conversations").where((F.col("role") == "user") & (F.col("conv_id") % TRUTH_EVERY == 0))
    labelled = conv.select("conv_id", "turn", split_ws("text").alias("tokens")).withColumn(
        "ner_tags", F.transform("tokens", lambda x: F.length(x) % 3))
    path = scratch_path(spark, "stream-truth")
    sinks.write_text(labelled.select("conv_id", "turn", F.to_json(F.struct("tokens", "ner_tags")).alias("line")), "line", path,
                     ["conv_id", "turn"])
    return stored(readers.load_lookup(spark, path, with_key=False).drop("seq"))


def stream_tagging(spark, sf):
    conv = stream_messages(spark, sf)
    src = scratch_path(spark, "stream-src")
    conv.write.parquet(src)
    files = len(listing(spark, src))
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    run_tagging_stream(spark, src, conv.schema, sink, ckpt, PreparedLexicon(doc_lexicon(spark, sf), LANG_TAGS),
                       stream_truth(spark, sf), ["conv_id", "turn"], "username", "text", F.col("role") == "user",
                       files_per_batch=max(1, -(-files // STREAM_BATCHES)), marks=MARKS)
    out = spark.read.schema("conv_id bigint, turn bigint, username string, reply_order int, role string, "
                            "message string, matched boolean, metric_source string, accuracy double, precision double, "
                            "recall double, f1 double").parquet(f"{sink}/batch_id=*")
    return out.select("conv_id", "turn", "username", F.col("reply_order").cast("long"), "role",
                      "message", "matched", "metric_source", *[r6(m).alias(m) for m in METRICS])


QUERIES = {
    "append_report": append_report,
    "optional_sources": optional_sources,
    "json_array_keys": json_array_keys,
    "preview_jsonl": preview_jsonl,
    "lookup_load": lookup_load,
    "lookup_faults": lookup_faults,
    "text_roundtrip": text_roundtrip,
    "jsonl_roundtrip": jsonl_roundtrip,
    "split_cache": split_cache,
    "json_array_scan": json_array_scan,
    "parallel_json_scan": parallel_json_scan,
    "stream_tagging": stream_tagging,
}

# ----------------------------------------------------------------- oracle ----

_J = O.joined
_LINES = O.lines_cte("doc_lines", "documents", "text", "doc_id, lang, source")
_LANG_ID = O._LANG_ID

SQL = {}

SQL["json_array_keys"] = r"""SELECT DISTINCT unnest(regexp_extract_all(j, '"([^"]+)":\s*\[', 1)) AS key FROM (
  SELECT '{"' || source || '_X": [' || n_chars || '], "' || lang || '_Y":[1], "meta": {"n": ' || n_chars
         || '}, "text": "' || text || '"}' AS j FROM documents)"""

SQL["preview_jsonl"] = f"""WITH l AS (
  SELECT doc_id, 0 AS kind, lang,
         '{{"doc_id": ' || doc_id || ', "lang": "' || lang || '", "n_chars": ' || n_chars || '}}' AS line
  FROM documents
  UNION ALL SELECT doc_id, 1, NULL, '' FROM documents WHERE doc_id % {BLANK_EVERY} = {BLANK_AT}
  UNION ALL SELECT doc_id, 2, NULL, '{{"doc_id": ' || doc_id || ', "lang": ' FROM documents
  WHERE doc_id % {BAD_EVERY} = {BAD_AT}),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id, kind) AS line_no FROM l)
SELECT line_no::BIGINT AS line_no, kind <> 0 AS is_bad, CASE WHEN kind = 0 THEN doc_id END AS doc_id,
       CASE WHEN kind = 0 THEN lang END AS lang,
       CASE WHEN kind = 0 THEN replace(replace(replace(line, '{{', '{{' || chr(10) || '  '), ', ', ',' || chr(10) || '  '),
         '}}', chr(10) || '}}') ELSE trim(line) END AS content
FROM n WHERE line_no <= {PREVIEW_N}"""

SQL["append_report"] = "SELECT role, count(*)::BIGINT AS n, max(turn) AS last_turn FROM conversations GROUP BY role"

SQL["optional_sources"] = """SELECT 'documents' AS source, true AS present, count(*)::BIGINT AS n FROM documents
UNION ALL SELECT 'no_such_table', false, 0 UNION ALL SELECT 'benchmark', true, count(*)::BIGINT FROM benchmark"""

_LOOKUP_LINES = f"""{O.TAG_CTES},
l AS (
  SELECT doc_id, line_no, 0 AS kind, tokens, tags FROM tagged
  UNION ALL SELECT doc_id, line_no, 1, NULL, NULL FROM tagged
  WHERE doc_id % {BLANK_EVERY} = {BLANK_AT} AND line_no = 0
  UNION ALL SELECT doc_id, line_no, 2, NULL, NULL FROM tagged
  WHERE doc_id % {BAD_EVERY} = {BAD_AT} AND line_no = 0),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no, kind) AS num FROM l)"""

SQL["lookup_faults"] = f"""WITH {_LOOKUP_LINES}
SELECT count(*)::BIGINT AS n_lines, count(*) FILTER (kind = 1)::BIGINT AS n_blank,
       count(*) FILTER (kind = 2)::BIGINT AS n_bad FROM n"""

SQL["lookup_load"] = f"""WITH {_LOOKUP_LINES},
kept AS (SELECT * FROM n WHERE kind = 0),
k AS (SELECT {O.normalize("array_to_string(tokens, ' ')")} AS key, tags, num FROM kept)
SELECT key, {_J('arg_max(tags, num)')} AS ner_tags, max(num)::BIGINT AS seq FROM k GROUP BY key"""

SQL["text_roundtrip"] = f"""WITH {O.sources_cte()},
s AS (SELECT DISTINCT {O.strip('text')} AS s FROM items WHERE text IS NOT NULL)
SELECT line, count(*)::BIGINT AS n FROM (
  SELECT unnest(string_split_regex(s, '\\r\\n|\\r|\\n')) AS line FROM s) GROUP BY line"""

SQL["jsonl_roundtrip"] = f"""WITH {O.TAG_CTES}
SELECT {_J('tokens')} AS tokens, {_J('tags')} AS ner_tags, count(*)::BIGINT AS n FROM tagged GROUP BY ALL"""

SQL["split_cache"] = f"""WITH {O.ALIGN_CTE},
sp AS (SELECT doc_id, line_no, row_number() OVER (ORDER BY {O.h('doc_id, line_no', SEED)}, doc_id, line_no) AS r,
              count(*) OVER () AS n FROM al)
SELECT doc_id, line_no, window_no, len(w)::BIGINT AS n_sub,
       len(list_filter(labels, lambda x: x <> -100))::BIGINT AS n_labelled
FROM win JOIN sp USING (doc_id, line_no) WHERE r <= ceil(0.1 * n)"""

SQL["json_array_scan"] = f"""WITH {_LINES}
SELECT doc_id, line_no AS pos, {O.strip('line')} AS sentence FROM doc_lines"""

SQL["parallel_json_scan"] = f"""WITH {_LINES}
SELECT DISTINCT {O.strip('line')} AS sentence FROM doc_lines
WHERE lang IN ({", ".join(repr(x) for x in KEEP_LANGS)})"""

SQL["stream_tagging"] = f"""WITH {O.TAG_CTES},
msgs AS (SELECT conv_id, turn, 'u' || conv_id AS username, text, {O.normalize('text')} AS norm
         FROM conversations WHERE role = 'user' AND conv_id % {GUEST_EVERY} <> {GUEST_AT}),
tk AS (SELECT conv_id, turn, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token
       FROM (SELECT conv_id, turn, {O.split_ws('norm')} AS toks FROM msgs)),
tg AS (SELECT tk.*, coalesce({_LANG_ID}, 0) AS tag FROM tk LEFT JOIN lexicon l ON lower(tk.token) = l.token),
agg AS (SELECT conv_id, turn, list(token ORDER BY pos) AS tokens, list(tag ORDER BY pos) AS tags
        FROM tg GROUP BY conv_id, turn),
shares AS (SELECT conv_id, turn, avg(CASE WHEN tag <> 0 THEN l.n / l.total END) AS share
           FROM tg LEFT JOIN lexicon l ON lower(tg.token) = l.token GROUP BY conv_id, turn),
given AS (SELECT conv_id, turn, {O.split_ws('text')} AS toks FROM conversations
          WHERE role = 'user' AND conv_id % {TRUTH_EVERY} = 0),
truth AS (SELECT {O.normalize("array_to_string(toks, ' ')")} AS key,
            arg_max(list_transform(toks, lambda x: length(x) % 3), (conv_id, turn)) AS truth FROM given GROUP BY key),
rep AS (SELECT m.conv_id, m.turn, m.username, m.text, t.key IS NOT NULL AS matched, t.truth, a.tags,
          coalesce(share, 0.8) AS share, coalesce({O.marked('a.tokens', 'a.tags')}, '') AS reply
        FROM msgs m LEFT JOIN agg a USING (conv_id, turn) LEFT JOIN shares USING (conv_id, turn)
        LEFT JOIN truth t ON t.key = m.norm),
pairs AS (SELECT conv_id, turn, unnest(truth[:least(len(truth), len(tags))]) AS y_true,
            unnest(tags[:least(len(truth), len(tags))]) AS y_pred FROM rep WHERE matched),
counted AS (SELECT conv_id, turn, {O.COUNTS_SELECT} FROM pairs GROUP BY conv_id, turn),
real AS (SELECT conv_id, turn, {O.prf_select('weighted')} FROM counted),
proxy AS (SELECT conv_id, turn, {O.proxy_cols('share')} FROM rep WHERE NOT matched),
m AS (SELECT conv_id, turn, accuracy, precision, recall, f1 FROM real UNION ALL SELECT * FROM proxy),
x AS (SELECT rep.*, CASE WHEN matched THEN 'truth' ELSE 'proxy' END AS metric_source, m.accuracy, m.precision, m.recall, m.f1
      FROM rep LEFT JOIN m USING (conv_id, turn))
SELECT conv_id, turn, username, 0::BIGINT AS reply_order, 'user' AS role, text AS message, matched, metric_source,
  accuracy, precision, recall, f1 FROM x
UNION ALL
SELECT conv_id, turn, username, 1::BIGINT, 'assistant', reply, matched, metric_source, accuracy, precision, recall, f1 FROM x"""
