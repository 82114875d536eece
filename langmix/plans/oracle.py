"""Oracle SQL (DuckDB) for the registered queries.

DuckDB uses RE2: ``\\s``/``\\d``/``\\b`` are ASCII and the replacement is
``\\1``. The driver tables contain no non-ASCII whitespace or digits, so the
RE2 spellings below select the same text as the Java ones."""

from __future__ import annotations

from langmix.plans import common as C

# ------------------------------------------------------------- fragments -----


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


# The rewriting rules as RE2 spells them
_CLEAN_RULES = [
    (r"\(\d{2}/\d{2}/\d{4}\)", " "),
    (r"(?i)\[\d{1,2}:\d{2}\s*(?:AM|PM|PETANG|PAGI|MALAM)?\]", " "),
    (r"http\S+|www\S+", ""),
    (r"@[^\s]+", ""),
    (r"#([^\s]+)", r"\1"),
    (r"\b\d{10,12}\b", ""),
    (r"(\+6)?01\d-?\d{7,8}", ""),
    (r"[~=+/|]", " "),
    (r"\.{2,}", " ... "),
    (r'([.,!?()\[\]{};:"”“\-])', r" \1 "),
]


def clean_core(x: str) -> str:
    t = x
    for pat, rep in _CLEAN_RULES:
        t = f"regexp_replace({t}, '{pat}', '{rep}', 'g')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def split_ws(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda s: s <> '')"


def camel(x: str) -> str:
    return f"(regexp_matches({x}, '^[A-Z][a-z0-9]+[A-Z]') AND len({split_ws(x)}) < 5)"


def normalize(x: str) -> str:
    t = f"regexp_replace(lower({x}), '<.*?>', '', 'g')"
    t = rf"regexp_replace({t}, '[^a-zA-Z\s]', '', 'g')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def lines_cte(name: str, table: str, text: str, keys: str) -> str:
    return rf"""{name} AS (
  SELECT {keys}, (generate_subscripts(arr, 1) - 1)::BIGINT AS line_no, unnest(arr) AS line
  FROM (SELECT {keys}, string_split_regex({strip(text)}, '\r\n|\r|\n') AS arr FROM {table}))"""


def clean_cte(name: str, src: str, keys: str) -> str:
    return f"""{name} AS (
  SELECT {keys}, core AS text FROM (
    SELECT {keys}, line, {clean_core('line')} AS core FROM {src})
  WHERE line IS NOT NULL AND NOT coalesce({camel('line')}, false)
    AND core <> '' AND len(string_split(core, ' ')) >= 4)"""


DOC_CTES = ",\n".join([
    lines_cte("doc_lines", "documents", "text", "doc_id, lang, source"),
    clean_cte("clean_lines", "doc_lines", "doc_id, lang, source, line_no"),
])


def sources_cte(with_pos: bool = False) -> str:
    conv_pos = "row_number() OVER (ORDER BY conv_id, turn) - 1" if with_pos else "NULL"
    return f"""items AS (
  SELECT 'documents' AS source, 1 AS source_rank, doc_id AS pos, text FROM documents
  UNION ALL SELECT 'conversations', 2, {conv_pos}, text FROM conversations
  UNION ALL SELECT 'benchmark', 3, item_id, text FROM benchmark)"""


def h(cols: str, seed) -> str:
    return f"md5(concat_ws(':', {cols}, '{seed}'))"


def r6(x: str) -> str:
    return f"round({x}, {C.DIGITS})"


SPLIT_CTE = f"""split AS (
  SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {h('doc_id', C.SEED)}, doc_id)
                        <= ceil(0.1 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
  FROM documents)"""

SCORED_CTE = f"""base AS (
  SELECT vec_id, vec_id // {C.SENTENCE_SIZE} AS sentence_id, vec_id % {C.SENTENCE_SIZE} AS pos,
         CASE WHEN vec_id % {C.SENTENCE_SIZE} = 0 THEN -100 ELSE label % 3 END AS y_true,
         list_transform(embedding[1:3], lambda x: round(x::DOUBLE, {C.DIGITS})) AS la,
         list_transform(embedding[4:6], lambda x: round(x::DOUBLE, {C.DIGITS})) AS lb
  FROM embeddings),
scored0 AS (
  SELECT vec_id, sentence_id, pos, y_true, 'A' AS model, la AS logits FROM base
  UNION ALL SELECT vec_id, sentence_id, pos, y_true, 'B', lb FROM base),
scored1 AS (
  SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM scored0),
scored AS (
  SELECT vec_id, sentence_id, pos, y_true, model, logits, ex,
         list_position(logits, list_max(logits)) - 1 AS y_pred,
         list_max(ex) / list_sum(ex) AS conf
  FROM scored1)"""

COUNTS_SELECT = ",\n".join(
    f"sum(CASE WHEN y_true = {t} AND y_pred = {p} THEN 1 ELSE 0 END) AS n_{t}_{p}"
    for t in range(3) for p in range(3))


def prf_select(average: str, rounded: bool = True) -> str:
    """Accuracy/precision/recall/F1 over a relation with n_t_p columns."""
    rnd = r6 if rounded else (lambda x: f"({x})")
    total = " + ".join(f"n_{t}_{p}" for t in range(3) for p in range(3))
    correct = " + ".join(f"n_{c}_{c}" for c in range(3))
    parts_p, parts_r, parts_f, present, support = [], [], [], [], []
    for c in range(3):
        nt = "(" + " + ".join(f"n_{c}_{p}" for p in range(3)) + ")"
        npred = "(" + " + ".join(f"n_{t}_{c}" for t in range(3)) + ")"
        pc = f"(CASE WHEN {npred} > 0 THEN n_{c}_{c} / {npred} ELSE 0.0 END)"
        rc = f"(CASE WHEN {nt} > 0 THEN n_{c}_{c} / {nt} ELSE 0.0 END)"
        fc = f"(CASE WHEN {nt} + {npred} > 0 THEN 2 * n_{c}_{c} / ({nt} + {npred}) ELSE 0.0 END)"
        if average == "macro":
            parts_p.append(pc)
            parts_r.append(rc)
            parts_f.append(fc)
            present.append(f"(CASE WHEN {nt} + {npred} > 0 THEN 1 ELSE 0 END)")
        else:
            parts_p.append(f"{nt} * {pc}")
            parts_r.append(f"{nt} * {rc}")
            parts_f.append(f"{nt} * {fc}")
            support.append(nt)
    denom = "(" + " + ".join(present if average == "macro" else support) + ")"

    def avg(parts):
        return f"CASE WHEN {denom} > 0 THEN ({' + '.join(parts)}) / {denom} END"
    return f"""({total})::BIGINT AS n_tokens,
  {rnd(f'CASE WHEN ({total}) > 0 THEN ({correct}) / ({total}) END')} AS accuracy,
  {rnd(avg(parts_p))} AS precision, {rnd(avg(parts_r))} AS recall, {rnd(avg(parts_f))} AS f1"""


FIRST_WORD_CTE = f"""{SCORED_CTE},
sa AS (SELECT *, CASE WHEN pos = 0 THEN NULL ELSE (pos - 1) // 2 END AS w FROM scored),
nn AS (SELECT *, lag(w) OVER (PARTITION BY model, sentence_id ORDER BY pos) AS prev FROM sa WHERE w IS NOT NULL),
fw AS (SELECT * FROM nn WHERE prev IS DISTINCT FROM w),
conf AS (
  SELECT s.model, s.sentence_id, count(fw.w)::BIGINT AS n_words, coalesce(avg(fw.conf), 0.8) AS mean_conf
  FROM (SELECT DISTINCT model, sentence_id FROM sa) s LEFT JOIN fw USING (model, sentence_id)
  GROUP BY s.model, s.sentence_id)"""


def proxy_cols(p: str) -> str:
    q = f"greatest(0.0, least({p}, 1.0))"
    return f"""{r6(q)} AS accuracy, {r6(f'greatest(0.0, least({q} * 0.985, 1.0))')} AS precision,
  {r6(f'greatest(0.0, least({q} * 0.972, 1.0))')} AS recall,
  {r6(f'CASE WHEN {q} + 0.978 = 0 THEN 0.0 ELSE greatest(0.0, least(2 * {q} * 0.978 / ({q} + 0.978), 1.0)) END')} AS f1"""


WEIGHTED_CTE = f"""{SCORED_CTE},
sent_counts AS (
  SELECT model, sentence_id, {COUNTS_SELECT} FROM scored WHERE y_true <> -100 GROUP BY model, sentence_id),
weighted AS (SELECT model, sentence_id, {prf_select('weighted')} FROM sent_counts)"""

CUSTOMER_CTE = """inc AS (
  SELECT c_custkey, upper(c_name) AS c_name, c_mktsegment, c_custkey * 2 AS seq FROM customer
  WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')
  UNION ALL
  SELECT c_custkey, lower(c_name), 'FURNITURE', c_custkey * 2 + 1 FROM customer
  WHERE c_mktsegment = 'HOUSEHOLD')"""

# ---------------------------------------------------------------- queries ----

SQL: dict[str, str] = {}

SQL["corpus_union_dedup"] = f"""WITH {sources_cte()}
SELECT sha256(s) AS sentence_id, s AS sentence, min(source_rank)::BIGINT AS first_source
FROM (SELECT {strip('text')} AS s, source_rank FROM items WHERE text IS NOT NULL) GROUP BY s"""

SQL["corpus_label_filter"] = f"""SELECT doc_id, lang, {strip('text')} AS sentence FROM documents
WHERE lang IN ({", ".join(repr(x) for x in C.KEEP_LANGS)}) AND text IS NOT NULL"""

SQL["corpus_source_contribution"] = f"""WITH {sources_cte()},
firsts AS (SELECT min(source_rank) AS r FROM items WHERE text IS NOT NULL GROUP BY {strip('text')}),
per AS (
  SELECT i.source_rank, i.source, count(*)::BIGINT AS n_items,
         (SELECT count(*) FROM firsts f WHERE f.r = i.source_rank)::BIGINT AS n_new
  FROM items i WHERE text IS NOT NULL GROUP BY i.source_rank, i.source)
SELECT source_rank::BIGINT AS source_rank, source, n_items, n_new,
       (sum(n_new) OVER (ORDER BY source_rank))::BIGINT AS cum_unique FROM per"""

SQL["corpus_sorted_rank"] = f"""WITH {sources_cte()}
SELECT (row_number() OVER (ORDER BY s))::BIGINT AS rank, s AS sentence
FROM (SELECT DISTINCT {strip('text')} AS s FROM items WHERE text IS NOT NULL)"""

SQL["corpus_lines"] = f"""WITH {lines_cte("doc_lines", "documents", "text", "doc_id")}
SELECT doc_id, line_no, line FROM doc_lines"""

SQL["clean_documents"] = f"""WITH {DOC_CTES}
SELECT doc_id, line_no, text FROM clean_lines"""

SQL["clean_pages"] = f"""WITH {lines_cte("page_lines", "pages", "html", "page_id")},
{clean_cte("clean_page_lines", "page_lines", "page_id, line_no")}
SELECT page_id, line_no, text FROM clean_page_lines"""

SQL["normalize_documents"] = f"SELECT doc_id, {normalize('text')} AS norm_text FROM documents"

SQL["normalize_pages"] = f"SELECT page_id, {normalize('html')} AS norm_text FROM pages"

SQL["tokenize_counts"] = f"""WITH {DOC_CTES}
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(len(string_split(text, ' ')))::BIGINT AS n_tokens,
       max(len(string_split(text, ' ')))::BIGINT AS max_tokens
FROM clean_lines GROUP BY doc_id"""

_tag_case = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LANG_TAGS.items()) + " END"
SQL["label_map"] = f"""SELECT doc_id, lang, tag, label_id::BIGINT AS label_id,
  CASE label_id WHEN 0 THEN 'O' WHEN 1 THEN 'MS' WHEN 2 THEN 'EN' END AS label,
  CASE label_id WHEN 0 THEN 'Other' WHEN 1 THEN 'Malay' WHEN 2 THEN 'English' END AS display
FROM (SELECT doc_id, lang, tag,
             CASE WHEN tag = 'EN' THEN 2 WHEN tag = 'MS' THEN 1 ELSE 0 END AS label_id
      FROM (SELECT doc_id, lang, {_tag_case} AS tag FROM documents))"""

SQL["prompt_prefix"] = f"SELECT conv_id, turn, 'task: tag ' || {normalize('text')} AS prompt FROM conversations"

_limits = " OR ".join(f"(source = '{s}' AND pos < {n})" for s, n in C.PREFIX_LIMITS.items())
SQL["prefix_limits"] = f"""WITH {sources_cte(True)}
SELECT source, pos::BIGINT AS pos, text FROM items WHERE {_limits}"""

SQL["sample_capped"] = f"""WITH {sources_cte()},
u AS (SELECT DISTINCT {strip('text')} AS sentence FROM items WHERE text IS NOT NULL)
SELECT sentence, {h('sentence', C.SEED)} AS h FROM u
QUALIFY row_number() OVER (ORDER BY {h('sentence', C.SEED)}, sentence) <= {C.SAMPLE_CAP}"""

SQL["sample_fraction"] = f"""WITH {sources_cte()}
SELECT source, sentence, count(*)::BIGINT AS n FROM (
  SELECT source, {strip('text')} AS sentence FROM items WHERE text IS NOT NULL)
WHERE ('0x' || substr({h('sentence', C.SEED)}, 1, 8))::BIGINT < {C.SAMPLE_FRACTION} * 4294967296
GROUP BY source, sentence"""

SQL["history_one_user"] = f"""SELECT turn, role, text,
  (row_number() OVER (ORDER BY turn DESC))::BIGINT AS recency FROM conversations WHERE conv_id = {C.HISTORY_USER}"""

SQL["clean_injected"] = f"""WITH {lines_cte("doc_lines", "documents", "text", "doc_id")},
inj AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '(08/06/2021) ' || line WHEN 1 THEN '[4:14 petang] ' || line
  WHEN 2 THEN 'ReleaseThe ' || string_split(line, ' ')[1] WHEN 3 THEN line || '...ok' END AS line
  FROM doc_lines WHERE line_no = 0),
{clean_cte("cleaned", "inj", "doc_id")}
SELECT doc_id, text FROM cleaned"""

SQL["split_train_test"] = f"WITH {SPLIT_CTE} SELECT doc_id, split FROM split"

SQL["eval_subset"] = f"""WITH {SPLIT_CTE}
SELECT doc_id, (row_number() OVER (ORDER BY {h('doc_id', C.EVAL_SEED)}, doc_id))::BIGINT AS pick
FROM split WHERE split = 'test' QUALIFY pick <= {C.EVAL_K}"""

SQL["prefix_take"] = f"""WITH {SPLIT_CTE}
SELECT doc_id, (row_number() OVER (ORDER BY {h('doc_id', C.SEED)}, doc_id))::BIGINT AS pick
FROM split WHERE split = 'train' QUALIFY pick <= {C.PREFIX_K}"""

SQL["zip_join"] = """WITH labs AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id AS label_doc_id, quality FROM labels),
docs AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, lang FROM documents)
SELECT pos, doc_id, lang, label_doc_id, quality::BIGINT AS quality FROM docs JOIN labs USING (pos)"""

SQL["open_class_prf"] = """WITH t AS (
  SELECT vec_id // 100 AS part, CASE WHEN vec_id % 11 <> 0 THEN label % 4 END AS y,
         CASE WHEN vec_id % 13 <> 0 THEN label % 5 END AS p FROM embeddings),
a AS (SELECT part, count(y)::BIGINT AS n_tokens, (count(*) - count(y))::BIGINT AS n_null_truth,
             avg(CASE WHEN y IS NULL THEN NULL WHEN y = p THEN 1.0 ELSE 0.0 END) AS accuracy FROM t GROUP BY part),
k AS (SELECT part, c, count(*) FILTER (y = c) AS nt, count(*) FILTER (p = c) AS np, count(*) FILTER (y = c AND p = c) AS tp
      FROM t, range(5) r(c) WHERE y IS NOT NULL GROUP BY part, c),
m AS (SELECT part, avg(CASE WHEN np > 0 THEN tp / np ELSE 0.0 END) AS p, avg(CASE WHEN nt > 0 THEN tp / nt ELSE 0.0 END) AS r,
             avg(2 * tp / (nt + np)) AS f FROM k WHERE nt + np > 0 GROUP BY part)
SELECT part, n_tokens, n_null_truth, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
       round(f, 6) AS f1 FROM a LEFT JOIN m USING (part)"""

SQL["lookup_last_wins"] = f"""WITH truth AS (
  SELECT {normalize(f"array_to_string({split_ws('d.text')}, ' ')")} AS key, d.doc_id AS seq, l.quality, l.toxic
  FROM labels l JOIN documents d USING (doc_id)),
last AS (SELECT key, max(seq) AS seq, arg_max(quality, seq) AS quality, arg_max(toxic, seq) AS toxic
         FROM truth GROUP BY key),
req AS (SELECT doc_id, {normalize('text')} AS key FROM documents)
SELECT r.doc_id, last.seq IS NOT NULL AS matched, last.seq AS truth_seq,
       last.quality::BIGINT AS quality, last.toxic::BIGINT AS toxic
FROM req r LEFT JOIN last USING (key)"""

SQL["chat_history"] = """SELECT conv_id, turn, role,
  (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC))::BIGINT AS recency FROM conversations"""

SQL["insert_if_absent"] = f"""WITH {CUSTOMER_CTE},
base AS (SELECT c_custkey, c_name, c_mktsegment FROM customer
         WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')),
first AS (SELECT c_custkey, arg_min(c_name, seq) AS c_name, arg_min(c_mktsegment, seq) AS c_mktsegment
          FROM inc GROUP BY c_custkey)
SELECT c_custkey, c_name, c_mktsegment, 'base' AS origin FROM base
UNION ALL
SELECT c_custkey, c_name, c_mktsegment, 'incoming' FROM first
WHERE c_custkey NOT IN (SELECT c_custkey FROM base)"""

SQL["rows_exist"] = f"""WITH {CUSTOMER_CTE}
SELECT c_custkey, c_mktsegment FROM customer c
WHERE EXISTS (SELECT 1 FROM inc i WHERE i.c_custkey = c.c_custkey AND i.c_mktsegment = c.c_mktsegment)"""

SQL["softmax_argmax"] = f"""WITH {SCORED_CTE}
SELECT model, vec_id, {r6('ex[1] / list_sum(ex)')} AS p0, {r6('ex[2] / list_sum(ex)')} AS p1,
       {r6('ex[3] / list_sum(ex)')} AS p2, y_pred::BIGINT AS y_pred, {r6('conf')} AS conf
FROM scored"""

SQL["confidence_mean"] = f"""WITH {FIRST_WORD_CTE}
SELECT model, sentence_id, n_words, {r6('mean_conf')} AS mean_conf FROM conf"""

SQL["confidence_proxy"] = f"""WITH {FIRST_WORD_CTE}
SELECT model, sentence_id, {r6('mean_conf')} AS mean_conf, {proxy_cols('mean_conf')} FROM conf"""

SQL["confusion_matrix"] = f"""WITH {SCORED_CTE},
grid AS (SELECT m.model, t.y AS y_true, p.y AS y_pred
         FROM (SELECT DISTINCT model FROM scored) m, (VALUES (0), (1), (2)) t(y), (VALUES (0), (1), (2)) p(y)),
cnt AS (SELECT model, y_true, y_pred, count(*) AS n FROM scored WHERE y_true <> -100 GROUP BY ALL)
SELECT g.model, g.y_true::BIGINT AS y_true, g.y_pred::BIGINT AS y_pred, coalesce(c.n, 0)::BIGINT AS n
FROM grid g LEFT JOIN cnt c USING (model, y_true, y_pred)"""

_MODEL_COUNTS = f"""{SCORED_CTE},
mc AS (SELECT model, {COUNTS_SELECT} FROM scored WHERE y_true <> -100 GROUP BY model)"""

SQL["accuracy"] = f"""WITH {_MODEL_COUNTS}
SELECT model, n_tokens, accuracy FROM (SELECT model, {prf_select('macro')} FROM mc)"""

SQL["macro_prf"] = f"""WITH {_MODEL_COUNTS}
SELECT model, {prf_select('macro')} FROM mc"""

SQL["weighted_sentence_prf"] = f"""WITH {WEIGHTED_CTE}
SELECT * FROM weighted"""

SQL["span_prf"] = f"""WITH {SCORED_CTE},
v AS (SELECT *, row_number() OVER (PARTITION BY model, sentence_id ORDER BY pos) AS i
      FROM scored WHERE y_true <> -100),
t1 AS (SELECT model, sentence_id, i, y_true AS lab,
              CASE WHEN lag(y_true) OVER w IS NOT DISTINCT FROM y_true THEN 0 ELSE 1 END AS nw
       FROM v WINDOW w AS (PARTITION BY model, sentence_id ORDER BY pos)),
p1 AS (SELECT model, sentence_id, i, y_pred AS lab,
              CASE WHEN lag(y_pred) OVER w IS NOT DISTINCT FROM y_pred THEN 0 ELSE 1 END AS nw
       FROM v WINDOW w AS (PARTITION BY model, sentence_id ORDER BY pos)),
t2 AS (SELECT *, sum(nw) OVER (PARTITION BY model, sentence_id ORDER BY i) AS run FROM t1),
p2 AS (SELECT *, sum(nw) OVER (PARTITION BY model, sentence_id ORDER BY i) AS run FROM p1),
ts AS (SELECT model, sentence_id, lab, min(i) AS s, max(i) AS e FROM t2 WHERE lab <> 0 GROUP BY model, sentence_id, run, lab),
ps AS (SELECT model, sentence_id, lab, min(i) AS s, max(i) AS e FROM p2 WHERE lab <> 0 GROUP BY model, sentence_id, run, lab),
agg AS (
  SELECT m.model,
    (SELECT count(*) FROM ts WHERE ts.model = m.model) AS n_true,
    (SELECT count(*) FROM ps WHERE ps.model = m.model) AS n_pred,
    (SELECT count(*) FROM ts JOIN ps USING (model, sentence_id, lab, s, e) WHERE ts.model = m.model) AS tp,
    (SELECT avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FROM v WHERE v.model = m.model) AS accuracy
  FROM (SELECT DISTINCT model FROM v) m)
SELECT model, n_true::BIGINT AS n_true, n_pred::BIGINT AS n_pred, tp::BIGINT AS tp,
  {r6('CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END')} AS precision,
  {r6('CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END')} AS recall,
  {r6('CASE WHEN n_true + n_pred > 0 THEN 2 * tp / (n_true + n_pred) ELSE 0.0 END')} AS f1,
  {r6('accuracy')} AS accuracy
FROM agg"""

SQL["model_comparison"] = f"""WITH {_MODEL_COUNTS},
m AS (SELECT model, f1 AS f1_raw, accuracy AS acc FROM (
  SELECT model, {prf_select('macro', rounded=False)} FROM mc))
SELECT model, {r6('f1_raw * 100')} AS f1_pct, {r6('acc')} AS accuracy,
       count(*) OVER () = {len(C.MODELS)} AS all_present FROM m"""

SQL["best_by_metric"] = f"""WITH {SCORED_CTE},
st AS (SELECT *, (vec_id // {C.STEP_SIZE} + 1) * {C.STEP_SIZE} AS step FROM scored),
sc AS (SELECT model, step, {COUNTS_SELECT} FROM st WHERE y_true <> -100 GROUP BY model, step),
log AS (SELECT model, step, f1 FROM (SELECT model, step, {prf_select('macro')} FROM sc) WHERE f1 IS NOT NULL)
SELECT model, arg_min(step, (-f1, step))::BIGINT AS best_step, max(f1) AS best_f1 FROM log GROUP BY model"""

SQL["metric_select"] = f"""WITH {FIRST_WORD_CTE},
sent_counts AS (
  SELECT model, sentence_id, {COUNTS_SELECT} FROM scored WHERE y_true <> -100
  GROUP BY model, sentence_id),
w AS (SELECT model, sentence_id, accuracy AS acc_raw, precision AS p_raw, recall AS r_raw, f1 AS f_raw FROM (
  SELECT model, sentence_id, {prf_select('weighted', rounded=False)} FROM sent_counts)),
t AS (SELECT DISTINCT doc_id AS sentence_id FROM labels)
SELECT c.model, c.sentence_id,
  CASE WHEN t.sentence_id IS NOT NULL THEN '{C.MATCHED}' ELSE '{C.FALLBACK}' END AS metric_source,
  CASE WHEN t.sentence_id IS NOT NULL THEN {r6('w.acc_raw')} ELSE {r6('greatest(0.0, least(c.mean_conf, 1.0))')} END AS accuracy,
  CASE WHEN t.sentence_id IS NOT NULL THEN {r6('w.p_raw')} ELSE {r6('greatest(0.0, least(greatest(0.0, least(c.mean_conf, 1.0)) * 0.985, 1.0))')} END AS precision,
  CASE WHEN t.sentence_id IS NOT NULL THEN {r6('w.r_raw')} ELSE {r6('greatest(0.0, least(greatest(0.0, least(c.mean_conf, 1.0)) * 0.972, 1.0))')} END AS recall,
  CASE WHEN t.sentence_id IS NOT NULL THEN {r6('w.f_raw')} ELSE {r6('greatest(0.0, least(2 * greatest(0.0, least(c.mean_conf, 1.0)) * 0.978 / (greatest(0.0, least(c.mean_conf, 1.0)) + 0.978), 1.0))')} END AS f1
FROM conf c LEFT JOIN t USING (sentence_id) LEFT JOIN w USING (model, sentence_id)"""

# --------------------------------------------------------------- tagging -----

_LANG_ID = "CASE l.lang " + " ".join(
    f"WHEN '{k}' THEN {2 if v == 'EN' else 1}" for k, v in C.LANG_TAGS.items()) + " ELSE 0 END"

TAG_CTES = rf"""{DOC_CTES},
lex_tokens AS (SELECT lower(unnest(string_split(text, ' '))) AS token, lang FROM clean_lines),
lex_counts AS (SELECT token, lang, count(*) AS n FROM lex_tokens
               WHERE regexp_matches(token, '^\p{{L}}+$') AND lang IS NOT NULL GROUP BY token, lang),
lex_best AS (SELECT token, sum(n) AS total, arg_min(lang, (-n, lang)) AS lang, max(n) AS n
             FROM lex_counts GROUP BY token),
lexicon AS (SELECT token, lang, n::BIGINT AS n, total::BIGINT AS total FROM lex_best
            WHERE total >= 2 AND n * 100 >= total * 60),
tok AS (SELECT doc_id, line_no, source, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token
        FROM (SELECT doc_id, line_no, source, string_split(text, ' ') AS toks FROM clean_lines)),
tagged_tok AS (SELECT t.*, coalesce({_LANG_ID}, 0) AS tag
               FROM tok t LEFT JOIN lexicon l ON lower(t.token) = l.token),
tagged AS (SELECT doc_id, line_no, source, list(token ORDER BY pos) AS tokens, list(tag ORDER BY pos) AS tags
           FROM tagged_tok GROUP BY doc_id, line_no, source)"""


def marked(tokens: str, tags: str) -> str:
    """Rendered text of the tagged tokens."""
    cases = " ".join(f"WHEN {k} THEN '{v.split('{t}')[0]}' || t || '{v.split('{t}')[1]}'" for k, v in C.MARKS.items())
    return f"""trim(array_to_string(list_transform({tokens}, lambda t, i:
  CASE {tags}[i] {cases} ELSE t END), ' '))"""


def joined(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda v: coalesce(v::VARCHAR, 'N')), ' ')"


SQL["lexicon"] = f"WITH {TAG_CTES} SELECT token, lang, n, total FROM lexicon"

SQL["tag_tokens"] = f"""WITH {TAG_CTES}
SELECT doc_id, line_no, {joined('tokens')} AS tokens, {joined('tags')} AS ner_tags,
       len(tokens)::BIGINT AS n_tokens FROM tagged"""

SQL["label_distribution"] = f"""WITH {TAG_CTES},
c AS (SELECT t.source, l.y AS label_id, sum(len(list_filter(t.tags, lambda x: x = l.y))) AS n
      FROM tagged t, (VALUES (0), (1), (2)) l(y) GROUP BY t.source, l.y)
SELECT source, label_id::BIGINT AS label_id, n::BIGINT AS n,
       {r6('CASE WHEN sum(n) OVER (PARTITION BY source) > 0 THEN n / sum(n) OVER (PARTITION BY source) END')} AS share
FROM c"""

SQL["sentence_profile"] = f"""WITH {TAG_CTES},
p AS (SELECT doc_id, line_no, tags, list_filter(tags, lambda x: x <> 0) AS nz FROM tagged)
SELECT doc_id, line_no,
  len(list_filter(tags, lambda x: x = 0))::BIGINT AS n_o,
  len(list_filter(tags, lambda x: x = 1))::BIGINT AS n_ms,
  len(list_filter(tags, lambda x: x = 2))::BIGINT AS n_en,
  (len(list_filter(tags, lambda x: x = 1)) > 0 AND len(list_filter(tags, lambda x: x = 2)) > 0) AS code_switched,
  len(list_filter(list_transform(nz, lambda x, i: i > 1 AND nz[i - 1] <> x), lambda b: b))::BIGINT AS switch_points
FROM p"""

SQL["paired_sequences_prf"] = f"""WITH {TAG_CTES},
nt AS (SELECT doc_id, line_no, generate_subscripts(toks, 1) AS i, unnest(toks) AS token
       FROM (SELECT doc_id, line_no, {split_ws(normalize("array_to_string(tokens, ' ')"))} AS toks FROM tagged)),
pred AS (SELECT n.doc_id, n.line_no, n.i, coalesce({_LANG_ID}, 0) AS y_pred
         FROM nt n LEFT JOIN lexicon l ON lower(n.token) = l.token),
tr AS (SELECT doc_id, line_no, source, 'positional' AS mode, pos + 1 AS i, tag AS y_true FROM tagged_tok
  UNION ALL SELECT doc_id, line_no, source, 'aligned', row_number() OVER (PARTITION BY doc_id, line_no ORDER BY pos), tag
  FROM tagged_tok WHERE {normalize('token')} <> ''),
pc AS (SELECT mode, source, {COUNTS_SELECT} FROM tr JOIN pred USING (doc_id, line_no, i) GROUP BY mode, source)
SELECT mode, source, {prf_select('weighted')} FROM pc"""

_names = "CASE tags[i] " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in {0: "O", 1: "Malay", 2: "english"}.items()) + " END"
SQL["parse_tagged"] = f"""WITH {TAG_CTES},
dec AS (SELECT doc_id, line_no,
          array_to_string(list_transform(tokens, lambda t, i: '[' || t || '] -> ' || {_names}), ' | ') AS decoded
        FROM tagged),
items AS (SELECT doc_id, line_no,
            list_filter(string_split(decoded, ' | '), lambda it: contains(it, '->')) AS its FROM dec),
pairs AS (SELECT doc_id, line_no, list_filter(list_transform(its, lambda it: {{
              'token': trim(replace(replace(split_part(it, '->', 1), '[', ''), ']', '')),
              'label': upper(trim(split_part(it, '->', 2)))}}),
            lambda p: lower(p.token) <> 'tag' AND p.token <> '') AS ps FROM items)
SELECT doc_id, line_no, {joined('list_transform(ps, lambda p: p.token)')} AS tokens,
  {joined("list_transform(ps, lambda p: CASE WHEN contains(p.label, 'ENG') THEN 2 WHEN contains(p.label, 'MAL') THEN 1 ELSE 0 END)")} AS labels,
  len(ps)::BIGINT AS n
FROM pairs"""

SQL["annotate_text"] = f"""WITH {TAG_CTES}
SELECT doc_id, line_no, {marked('tokens', 'tags')} AS annotated FROM tagged"""

_WORDS = "flatten(list_transform(tokens, lambda t, i: list_transform(range(greatest(ceil(length(t) / 4), 1)::BIGINT), lambda j: i - 1)))"
_ROOM = 510   # positions of a window between its two special ones
ALIGN_CTE = f"""{TAG_CTES},
wi AS (SELECT doc_id, line_no, tags, tokens, [NULL::BIGINT] || ({_WORDS}) || [NULL::BIGINT] AS w FROM tagged),
al AS (SELECT doc_id, line_no, w, tags, list_transform(w, lambda x, i:
         CASE WHEN x IS NULL THEN -100 WHEN i > 1 AND w[i - 1] IS NOT DISTINCT FROM x THEN -100
              ELSE tags[x + 1] END) AS labels FROM wi),
wn AS (SELECT *, unnest(range(greatest(1, ceil((len(w) - 2) / {_ROOM})::BIGINT))) AS window_no FROM al),
win AS (SELECT doc_id, line_no, window_no,
  [NULL::BIGINT] || w[window_no * {_ROOM} + 2 : least(window_no * {_ROOM} + {_ROOM + 1}, len(w) - 1)] || [NULL::BIGINT] AS w,
  [-100] || labels[window_no * {_ROOM} + 2 : least(window_no * {_ROOM} + {_ROOM + 1}, len(w) - 1)] || [-100] AS labels
  FROM wn)"""

SQL["align_array"] = f"""WITH {ALIGN_CTE}
SELECT doc_id, line_no, window_no, {joined('w')} AS word_ids, {joined('labels')} AS labels, len(w)::BIGINT AS n_sub
FROM win"""

SQL["align_long"] = f"""WITH {ALIGN_CTE}
SELECT doc_id, line_no, window_no, generate_subscripts(w, 1)::BIGINT - 1 AS sub_pos, unnest(w)::BIGINT AS word_idx,
  unnest(labels)::BIGINT AS label FROM win"""

SQL["align_stored"] = f"""WITH {ALIGN_CTE},
sub AS (SELECT doc_id, line_no, generate_subscripts(w, 1) - 1 AS sub_pos, unnest(w) AS word_idx, tags FROM wi)
SELECT doc_id, line_no, sub_pos::BIGINT AS sub_pos, word_idx::BIGINT AS word_idx,
  (CASE WHEN word_idx IS NULL THEN -100
        WHEN lag(word_idx) OVER (PARTITION BY doc_id, line_no ORDER BY sub_pos) IS NOT DISTINCT FROM word_idx THEN -100
        ELSE tags[word_idx + 1] END)::BIGINT AS label
FROM sub"""

SQL["model_udf_tagger"] = rf"""WITH {DOC_CTES}
SELECT doc_id, line_no, {joined("string_split(text, ' ')")} AS tokens,
  {joined("list_transform(string_split(text, ' '), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z]+$') THEN 2 WHEN regexp_matches(t, '^\\p{L}+$') THEN 1 ELSE 0 END)")} AS ner_tags
FROM clean_lines"""

_IDS = "flatten(list_transform(tokens, lambda t: list_transform(range(greatest(ceil(length(t) / 4), 1)::BIGINT), lambda j: unicode(substr(t, j * 4 + 1, 1)))))"
ENC_CTE = f"""{ALIGN_CTE},
full_ids AS (SELECT doc_id, line_no, {_IDS} AS ids FROM tagged),
enc AS (SELECT w.doc_id, w.line_no, w.window_no, w.w, w.labels,
          [101] || ids[window_no * {_ROOM} + 1 : (window_no + 1) * {_ROOM}] || [102] AS ids
        FROM win w JOIN full_ids USING (doc_id, line_no))"""

SQL["encode_udf"] = f"""WITH {ENC_CTE}
SELECT doc_id, line_no, window_no, {joined('ids')} AS input_ids, {joined('w')} AS word_ids, {joined('labels')} AS labels
FROM enc"""

SQL["score_udf"] = f"""WITH {ENC_CTE},
pos AS (SELECT doc_id, line_no, window_no, generate_subscripts(ids, 1) - 1 AS sub_pos, unnest(ids) AS x,
          unnest(labels) AS y FROM enc),
lg AS (SELECT doc_id, line_no, window_no, sub_pos, y,
         [round((x % 7) / 7.0, 6), round((x % 11) / 11.0, 6), round((x % 13) / 13.0, 6)] AS l FROM pos WHERE y <> -100),
ex AS (SELECT *, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM lg)
SELECT doc_id, line_no, window_no, sub_pos::BIGINT AS sub_pos, y::BIGINT AS y_true,
  (list_position(l, list_max(l)) - 1)::BIGINT AS y_pred, {r6('list_max(e) / list_sum(e)')} AS conf FROM ex"""

SQL["sequence_confidence"] = f"""WITH {SCORED_CTE}
SELECT model, sentence_id, count(*)::BIGINT AS n_steps, {r6('avg(conf)')} AS mean_conf
FROM scored GROUP BY model, sentence_id"""
