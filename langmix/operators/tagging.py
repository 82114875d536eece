"""Word-level language tagging.

Two back ends share one output contract ``(keys..., tokens, ner_tags)``:

* ``build_lexicon`` + ``tag_lines``: a lexicon of any size, broadcast or joined.
* ``model_tag_lines``: any user tagger run through ``mapInArrow``; the model
  is loaded once per task, one call per sentence with all its tokens.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.functions.labels import LABEL2ID
from langmix.functions.text import split_squeezed, split_ws, squeeze_ws, strip_ws
from langmix.operators.batches import TEXT_BYTES, bounded, lists, words
from langmix.session import ship_package, stored

# --- Fixed values -----------------------------------------------------------
WORD = r"^\p{L}+$"              # lexicon entries: letters only
MIN_COUNT = 2                   # token must occur at least this often
MIN_PURITY_PCT = 60             # best language share, in percent
BLOCK_BYTES = 32 << 20          # lexicon text in the broadcast, at most about
BLOCK_LINES = 1 << 15           # lines that ask a larger lexicon together, at most
BLOCK_TEXT = 8 << 20            # and their text, about
# -----------------------------------------------------------------------------


MAX_PACKED_LANGUAGES = 256  # size check for the packed (count, language) key
_LANG_BITS = 16
_COUNT_CEILING = 1 << 46


def known_languages(df: DataFrame, lang_col: str = "lang",
                    limit: int = MAX_PACKED_LANGUAGES) -> list[str] | None:
    """The distinct non-null languages in sorted order when there are at
    most ``limit`` of them (one small aggregation; at most ``limit + 1``
    rows reach the driver), else None."""
    rows = (df.select(F.col(lang_col).alias("l")).where(F.col("l").isNotNull()).distinct()
            .limit(limit + 1).collect())
    return None if len(rows) > limit else sorted(r["l"] for r in rows)


def build_lexicon(token_lang: DataFrame, token_col: str = "token", lang_col: str = "lang",
                  min_count: int = MIN_COUNT, min_purity_pct: int = MIN_PURITY_PCT,
                  languages: list[str] | None = None) -> DataFrame:
    """token -> language by majority with count and purity cut-offs; ties go
    to the smaller language name. Frequent tokens are collapsed by partial
    aggregation before the shuffle, so a token holding a third of all rows
    costs one row per map task.

    With the complete language list (``known_languages``, size-checked) the
    per-token choice packs ``(count, language rank)`` into one bigint, so
    the second aggregation is a hash aggregation on numbers; without it a
    ``min(struct(-count, language))`` is used, which Spark must sort."""
    return lexicon_of(token_counts(token_lang, token_col, lang_col), min_count, min_purity_pct, languages)


def token_counts(token_lang: DataFrame, token_col: str = "token", lang_col: str = "lang") -> DataFrame:
    """``(token, lang, n)`` of the words of one part of a corpus. Counts of
    several parts, kept side by side, add up (:func:`add_counts`)."""
    t = token_lang.select(F.lower(token_col).alias("token"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL")
    return _words_only(t.groupBy("token", "lang").agg(F.count(F.lit(1)).alias("n")))


def _words_only(counts: DataFrame) -> DataFrame:
    # a test that names the count stays above the aggregation, so each distinct
    # token is matched, not each occurrence
    return counts.where(F.when(F.col("n") > 0, F.col("token").rlike(WORD)))


def _count_words(batches):
    """(token, lang, n) of the distinct tokens of each part of the lines."""
    import numpy as np
    import pyarrow as pa

    for rb in bounded(batches, "_lower", TEXT_BYTES):
        split = words(rb.column("_lower"))
        tokens, langs = split.values.dictionary_encode(), rb.column("lang").dictionary_encode()
        lines = np.diff(split.offsets.to_numpy())
        pairs = np.repeat(langs.indices.to_numpy().astype(np.int64), lines) * len(tokens.dictionary) + tokens.indices.to_numpy()
        size = len(tokens.dictionary) * len(langs.dictionary)
        if size > 4 * len(pairs):   # many languages: sorted, not counted in place
            pairs, n = np.unique(pairs, return_counts=True)
        else:
            every = np.bincount(pairs, minlength=size)
            pairs = np.flatnonzero(every)
            n = every[pairs]
        lang, token = np.divmod(pairs, max(len(tokens.dictionary), 1))
        yield pa.RecordBatch.from_arrays([tokens.dictionary.take(pa.array(token)), langs.dictionary.take(pa.array(lang)), pa.array(n)],
                                         names=["token", "lang", "n"])


def line_token_counts(lines: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """:func:`token_counts` of the tokens of single-spaced lines. Each Arrow
    batch of lines is split and counted at once, so a task's aggregation gets
    a row for each distinct token of a batch, not one for each token."""
    ship_package(lines.sparkSession)
    lang = lines.schema[lang_col].dataType.simpleString()
    src = lines.select(F.lower(text_col).alias("_lower"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL")
    return _words_only(add_counts(src.mapInArrow(_count_words, f"token string, lang {lang}, n bigint")))


def add_counts(parts: DataFrame) -> DataFrame:
    """Counts of any number of parts as those of the whole corpus."""
    return parts.groupBy("token", "lang").agg(F.sum("n").alias("n"))


def lexicon_of(counts: DataFrame, min_count: int = MIN_COUNT, min_purity_pct: int = MIN_PURITY_PCT,
               languages: list[str] | None = None) -> DataFrame:
    """:func:`build_lexicon` from counts."""
    if languages is not None and len(languages) <= MAX_PACKED_LANGUAGES:
        names = F.array(*[F.lit(x) for x in sorted(languages)])
        rank = F.array_position(names, F.col("lang")) - 1
        key = F.shiftleft(F.lit(_COUNT_CEILING) - F.col("n"), _LANG_BITS) + rank
        best = (counts.select("token", "n", key.alias("_k")).groupBy("token")
                .agg(F.sum("n").alias("total"), F.min("_k").alias("_k")))
        out = best.select(
            "token", F.element_at(names, (F.col("_k").bitwiseAND((1 << _LANG_BITS) - 1) + 1).cast("int"))
            .alias("lang"),
            (F.lit(_COUNT_CEILING) - F.shiftright("_k", _LANG_BITS)).cast("long").alias("n"),
            F.col("total").cast("long").alias("total"))
    else:
        best = (counts.groupBy("token")
                .agg(F.sum("n").alias("total"),
                     F.min(F.struct((-F.col("n")).alias("neg"), F.col("lang").alias("lang"))).alias("b")))
        out = best.select("token", F.col("b.lang").alias("lang"), (-F.col("b.neg")).cast("long").alias("n"),
                          F.col("total").cast("long").alias("total"))
    return out.where((F.col("total") >= min_count)
                     & (F.col("n") * 100 >= F.col("total") * min_purity_pct))


def _tag_map(lang_to_tag: dict[str, str]):
    return F.create_map(*[x for k, v in lang_to_tag.items() for x in (F.lit(k), F.lit(LABEL2ID[v]))])


class PreparedLexicon:
    """The tagged entries of a lexicon, ready for any number of tagging runs
    (a stream prepares it once). Their size is measured: at most
    ``block_bytes`` of text travel as one broadcast (``block``); beyond that
    ``block`` is None and ``entries`` stays in Spark, to be joined."""

    def __init__(self, lexicon: DataFrame, lang_to_tag: dict[str, str], block_bytes: int = BLOCK_BYTES):
        import pyarrow as pa

        spark = lexicon.sparkSession
        ship_package(spark)
        share = F.col("n") / F.col("total") if {"n", "total"} <= set(lexicon.columns) else F.lit(1.0)
        self.entries = stored(lexicon.select("token", F.element_at(_tag_map(lang_to_tag), F.col("lang")).alias("tag"),
                                                  share.alias("share")).where("tag IS NOT NULL AND tag <> 0"))
        size = self.entries.agg(F.sum(F.octet_length("token") + 16)).first()[0] or 0
        self.block = None
        if size <= block_bytes:
            known = self.entries.toArrow()   # no Python object a row on the driver
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, known.schema) as out:
                out.write_table(known)
            self.block = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


def _tags_of(lower, known, confidence: bool) -> list:
    """Lists of tags for lists of lower-cased tokens, in one vectorized look-up
    in the entries ``known``: 0 where there is none. With ``confidence`` also
    lists of the shares of the tagged tokens, in order."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    tokens = known.column("token").combine_chunks()
    tag = np.concatenate((known.column("tag").to_numpy(), [0])).astype(np.int32)
    at = pc.fill_null(pc.index_in(lower.flatten(), tokens), len(tokens)).to_numpy(zero_copy_only=False)
    offsets = lower.offsets.to_numpy() - lower.offsets[0].as_py()
    out = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tag[at]))]
    if confidence:
        hit = at < len(tokens)
        ends = np.concatenate(([0], np.cumsum(hit)))[offsets]
        out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)),
                                            pa.array(known.column("share").to_numpy()[at[hit]], pa.float64())))
    return out


def _look_up(block, names: list[str], confidence: bool):
    """Tags of all tokens of an Arrow batch at once; the last column holds the
    lower-cased, single-spaced texts."""
    def run(batches):
        import pyarrow as pa

        known = pa.ipc.open_stream(block.value).read_all().combine_chunks()
        added = ["ner_tags", "shares"] if confidence else ["ner_tags"]
        for rb in bounded(batches, "_lower", TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([*rb.columns[:-1], *_tags_of(words(rb.column("_lower")), known, confidence)],
                                             names=[*names, *added])
    return run


def _blocks(names: list[str], block_lines: int):
    """Lines in blocks, a row each: its number, the lines (compressed Arrow;
    lower-cased texts only where Arrow lower-cases otherwise than Spark), and
    the distinct tokens that it asks for."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33

        def block(parts):
            lines = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            lower, sink = lines.column("_lower"), pa.BufferOutputStream()
            plain = pc.fill_null(pc.equal(pc.utf8_lower(lines.column("_text")), lower), False).to_numpy(zero_copy_only=False)
            other = lower.take(pa.array(np.arange(len(plain)), mask=plain))
            kept = pa.RecordBatch.from_arrays([*lines.columns[:-1], other], names=[*names, "_other"])
            with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(kept)
            asked = words(lower).flatten().unique()
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(asked)], pa.int32()), asked)], names=["_block", "_lines", "_asked"])

        held, lines, size = [], 0, 0
        for rb in bounded(batches, "_lower", TEXT_BYTES):
            while rb.num_rows:
                part = rb.slice(0, block_lines - lines)
                rb = rb.slice(part.num_rows)
                held, lines = [*held, part], lines + part.num_rows
                size += pc.sum(pc.binary_length(part.column("_lower"))).as_py()
                if lines >= block_lines or size >= BLOCK_TEXT:
                    yield block(held)
                    held, lines, size, number = [], 0, 0, number + 1
        if held:
            yield block(held)
    return run


def _map_back(names: list[str], confidence: bool):
    """Tags of one block of lines from the answers its tokens got."""
    def run(block, answers):
        import pyarrow as pa
        import pyarrow.compute as pc

        added = ["ner_tags", "shares"] if confidence else ["ner_tags"]
        lines = pa.ipc.open_stream(block.column("_lines")[0].as_buffer()).read_all().combine_chunks()
        lower = pc.coalesce(lines.column("_other"), pc.utf8_lower(lines.column("_text"))).combine_chunks()
        return pa.table([*[lines.column(n) for n in names], *_tags_of(words(lower), answers, confidence)], names=[*names, *added])
    return run


def _join_blocks(src: DataFrame, entries: DataFrame, names: list[str], schema: str, block_lines: int,
                 confidence: bool) -> DataFrame:
    """Tags by a join in Spark: each block of lines asks once for every
    distinct token, so a frequent token costs a row a block (a hot one is left
    to AQE's skew join), and the answers go back to their block, which travels
    compressed."""
    ship_package(src.sparkSession)
    blocks = stored(src.mapInArrow(_blocks(names, block_lines), "_block bigint, _lines binary, _asked array<string>"), "blocks")
    asked = blocks.select(F.col("_block").alias("_at"), F.explode("_asked").alias("token"))
    answers = asked.join(entries, "token").select("_at", "token", "tag", *(["share"] if confidence else []))
    return blocks.select("_block", "_lines").groupBy("_block").cogroup(answers.groupBy("_at")).applyInArrow(
        _map_back(names, confidence), schema)


def tag_lines(lines: DataFrame, lexicon: DataFrame | PreparedLexicon, keys: list[str], text_col: str,
              lang_to_tag: dict[str, str] | None = None, squeezed: bool = False,
              keep_empty: bool = False, block_lines: int = BLOCK_LINES, confidence: bool = False) -> DataFrame:
    """Tag every whitespace token: lexicon language -> tag id, unknown or
    non-word tokens -> 0. Empty lines yield no row, or with ``keep_empty``
    one without tokens. ``squeezed=True`` says
    the text is already single-spaced (clean_text output), so tokens come
    from a plain split instead of the whitespace regex.

    Against a broadcast lexicon tokens are looked up in the row, one
    vectorized look-up per Arrow batch: nothing is exploded, joined or
    shuffled, and lines go to Python and back as text, which is split where
    tokens are used. A larger lexicon is joined with the distinct tokens of blocks of
    ``block_lines`` lines, so neither the lexicon nor a part of it passes
    through the driver. ``confidence`` adds ``shares``: of each tagged token,
    in order, the share that its language has of the token's occurrences."""
    if not isinstance(lexicon, PreparedLexicon):
        lexicon = PreparedLexicon(lexicon, lang_to_tag)
    full = F.col(text_col) != "" if squeezed else strip_ws(text_col) != ""
    text = F.col(text_col) if squeezed else squeeze_ws(text_col)
    src = (lines if keep_empty else lines.where(full)).select(*keys, text.alias("_text"))
    added = ["ner_tags", "shares"] if confidence else ["ner_tags"]
    src = src.select(*keys, "_text", F.coalesce(F.lower("_text"), F.lit("")).alias("_lower"))
    names = src.columns[:-1]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]], "ner_tags array<int>",
                        *(["shares array<double>"] if confidence else [])])
    if lexicon.block is None:
        tagged = _join_blocks(src, lexicon.entries, names, schema, block_lines, confidence)
    else:
        tagged = src.mapInArrow(_look_up(lexicon.block, names, confidence), schema)
    return tagged.select(*keys, split_squeezed("_text").alias("tokens"), *added)


def model_tag_lines(lines: DataFrame, keys: list[str], text_col: str,
                    model_factory: Callable[[], Callable[[list[str]], list[str]]],
                    key_schema: str) -> DataFrame:
    """Tag with a user model through ``mapInArrow``. ``model_factory`` is
    called once per task (the model load), the returned callable once per
    sentence with all its tokens and returns one tag (EN / MS / other) per
    token. Empty sentences are skipped. The token column passes through as
    the same Arrow array; only the tags are built in Python."""
    import pyarrow as pa

    # emptiness is tested on the stripped text: a filter on the token array
    # would be pushed below the projection and split every line twice
    src = lines.where(strip_ws(text_col) != "").select(*keys, split_ws(text_col).alias("tokens"))
    to_id = {"EN": LABEL2ID["EN"], "MS": LABEL2ID["MS"]}  # anything else -> O
    other = LABEL2ID["O"]

    def run(batches):
        predict = model_factory()
        for rb in bounded(batches, "tokens"):
            tokens = rb.column("tokens")
            tags = [[to_id.get(p, other) for p in predict(toks)] for toks in lists(tokens)]
            yield pa.RecordBatch.from_arrays(
                [rb.column(k) for k in keys] + [tokens, pa.array(tags, pa.list_(pa.int32()))],
                names=list(keys) + ["tokens", "ner_tags"])

    ship_package(lines.sparkSession)
    return src.mapInArrow(run, f"{key_schema}, tokens array<string>, ner_tags array<int>")
