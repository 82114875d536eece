"""Sub-word alignment.

* ``align_labels`` (training walk): special position -> -100; first piece of
  a word -> that word's label; later pieces -> -100. "Previous" is updated on
  every position, nulls included.
* ``first_subwords`` (inference walk): nulls are skipped *without* updating
  "previous"; one row per word.

Both exist in-row (higher-order functions, no shuffle) and in long form
(``lag`` over the sentence; the training walk over packed rows)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langmix.functions.arrays import bound
from langmix.functions.labels import IGNORE_INDEX
from langmix.operators.batches import all_batches, bounded, int_lists, lists
from langmix.session import ship_package, stored

# --- Fixed values -----------------------------------------------------------
MAX_LEN = 512  # sequence length incl. the two special positions
# -----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def align_labels(word_ids, word_labels) -> Column:
    """In-row training alignment; ``get`` keeps out-of-range lookups null."""
    return bound(lambda words, labels: F.transform(
        words,
        lambda w, i: F.when(w.isNull() | F.get(words, i - 1).eqNullSafe(w), F.lit(IGNORE_INDEX))
        .otherwise(F.get(labels, w))), words=word_ids, labels=word_labels)


def piece_word_ids(tokens, piece_len: int = 4) -> Column:
    """Native stand-in encoder: each word is cut into ``piece_len``-character
    pieces; ``[null] + word index per piece + [null]``, whole."""
    t = _c(tokens)
    per_word = F.transform(t, lambda tok, i: F.array_repeat(
        i, F.greatest(F.ceil(F.length(tok) / piece_len), F.lit(1)).cast("int")))
    none = F.array(F.lit(None).cast("int"))
    return F.concat(none, F.flatten(per_word), none)


def windows(df: DataFrame, columns: dict[str, tuple], max_len: int = MAX_LEN) -> DataFrame:
    """Cut encoded sentences into consecutive windows of at most ``max_len``
    positions, ``window_no`` from 0: nothing is lost and every piece is in one
    window. ``columns`` maps each parallel array column to its first and last
    special value, which every window gets back. Labels are aligned before
    the cut, so a word that spans a border is labelled once."""
    room = max_len - 2
    some = next(iter(columns))
    last = F.greatest(F.ceil((F.size(some) - 2) / room), F.lit(1)).cast("int") - 1
    out = df.withColumn("window_no", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))

    def cut(name: str, ends: tuple) -> Column:
        kind = df.schema[name].dataType.elementType
        first, end = (F.array(F.lit(x).cast(kind)) for x in ends)
        start = F.col("window_no").cast("int") * room + 2
        return F.concat(first, F.slice(name, start, F.least(F.lit(room), F.size(name) - start)), end)

    return out.withColumns({name: cut(name, ends) for name, ends in columns.items()})


def align_long(sub_rows: DataFrame, word_labels: DataFrame, keys: list[str], sub_pos: str = "sub_pos",
               word_col: str = "word_idx", label_col: str = "label") -> DataFrame:
    """Long-form training alignment over ``(keys, sub_pos, word_idx)`` rows,
    with word labels ``(keys, word_idx, label)`` joined on the word; positions,
    word indexes and labels are integers.

    Rows of a sentence that follow one another are packed into one, kept in the
    shared folder. Both tables move once, packed, by sentence; the join and the
    walk go over many sentences at a time. A sentence's rows meet in one task's
    memory, at a few numbers each."""
    known = word_labels.select(*keys, word_col, F.when(F.col(word_col).isNull(), F.lit(IGNORE_INDEX))
                               .otherwise(F.col(label_col)).alias(label_col)).dropna(subset=[*keys, word_col])   # null joins nothing
    kinds, label_kind = dict(sub_rows.dtypes), dict(known.dtypes)[label_col]
    for kind in (kinds[sub_pos], kinds[word_col], dict(known.dtypes)[word_col], label_kind):
        if kind not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError(f"not an integer: {kind}")
    with all_batches(sub_rows.sparkSession):
        packed = stored(_packed(sub_rows, keys, sub_pos, word_col).withColumn("_of", F.lit("sub")).unionByName(
            _packed(known, keys, word_col, label_col).withColumn("_of", F.lit("label"))), "packed")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*keys).schema.fields)
    rows = packed.repartition(*keys).sortWithinPartitions(*keys, "_first").mapInArrow(
        _walk(keys), f"{schema}, _pos bigint, _word bigint, _label bigint")
    return rows.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], F.col("_pos").cast(kinds[sub_pos]).alias(sub_pos),
                       F.col("_word").cast(kinds[word_col]).alias(word_col), F.col("_label").cast(label_kind).alias("label"))


def _packed(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """``(keys, _first, _from, _steps)``: a row for rows in succession whose
    keys are the same, whose ``at`` counts up and whose values differ by little:
    where they begin, at what value, and the steps from one to the next, for a
    null value none."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for rb in batches:
            first, column = rb.column("_first"), rb.column("_from")
            pos, known = first.fill_null(0).to_numpy(), first.is_valid().to_numpy(zero_copy_only=False)
            new = _begins(rb, keys)
            new[1:] |= (pos[1:] != pos[:-1] + 1) | ~known[1:] | ~known[:-1]
            full = column.is_valid().to_numpy(zero_copy_only=False)
            last = np.maximum.accumulate(np.where(full | new, np.arange(len(pos)), 0))
            worth = column.fill_null(0).to_numpy()[last]   # a null stands at the value before it
            steps = np.diff(worth, prepend=0)
            new |= (steps > 100) | (steps < -100)
            starts = np.flatnonzero(new)
            steps = np.where(new, 0, steps).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [*[rb.column(k).take(pa.array(starts)) for k in keys], first.take(pa.array(starts)), pa.array(worth[starts]),
                 pa.ListArray.from_arrays(pa.array(np.append(starts, len(pos)).astype(np.int32)), pa.array(steps, mask=~full))],
                names=[*keys, "_first", "_from", "_steps"])

    ship_package(rows.sparkSession)
    src = rows.select(*keys, F.col(at).cast("long").alias("_first"), F.col(value).cast("long").alias("_from"))
    return src.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields], "_steps array<tinyint>"]))


def _begins(rb, keys: list[str], before=None):
    """Of each row, whether its keys differ from those of the row before it
    (of the first one, from those of ``before``'s last row); nulls are equal."""
    import numpy as np
    import pyarrow.compute as pc

    new = np.zeros(rb.num_rows, bool)
    for k in keys:
        x = rb.column(k)
        null = x.is_null().to_numpy(zero_copy_only=False)
        other = pc.fill_null(pc.not_equal(x[1:], x[:-1]), False).to_numpy(zero_copy_only=False)
        new[1:] |= other | (null[1:] != null[:-1])
    if len(new):
        new[0] = before is None or any(before.column(k)[-1].as_py() != rb.column(k)[0].as_py() for k in keys)
    return new


def _walk(keys: list[str]):
    """Sentences that :func:`_packed` made, sorted by keys, back as rows with
    their labels: those of a batch together, the last one with the next."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = []
        for rb in bounded(batches, "_steps"):
            cut = np.flatnonzero(_begins(rb, keys, held[-1] if held else None))
            if len(cut):
                if held or cut[-1]:
                    yield _aligned(pa.Table.from_batches([*held, rb.slice(0, cut[-1])]), keys)
                held, rb = [], rb.slice(cut[-1])
            held.append(rb)
        if held:
            yield _aligned(pa.Table.from_batches(held), keys)
    return run


def _opened(part, of: str):
    """The packed rows of one table: of each value its packed row, its
    position, the value, and whether it is null; by position."""
    import numpy as np
    import pyarrow.compute as pc

    rows = np.flatnonzero(pc.equal(part.column("_of"), of).to_numpy(zero_copy_only=False))
    lists = part.column("_steps").take(rows)
    sizes = np.diff(lists.offsets.to_numpy())
    begin = np.cumsum(sizes) - sizes
    null = lists.flatten().is_null().to_numpy(zero_copy_only=False)
    steps = np.cumsum(lists.flatten().fill_null(0).to_numpy(), dtype=np.int64)
    first = part.column("_first").fill_null(np.iinfo(np.int64).min).to_numpy()[rows]   # a null position is the first
    pos = np.arange(len(steps)) + np.repeat(first - begin, sizes)
    value = steps + np.repeat(part.column("_from").to_numpy()[rows] - steps[begin], sizes)   # a list begins with step 0
    return np.repeat(rows, sizes), pos, value, null


def _aligned(part, keys: list[str]):
    """The rows of whole sentences, walked."""
    import numpy as np
    import pyarrow as pa

    part = part.combine_chunks().to_batches()[0]
    sentence = np.cumsum(_begins(part, keys))
    row, pos, word, null = _opened(part, "sub")
    of = sentence[row]
    if ((of[1:] == of[:-1]) & (pos[1:] < pos[:-1])).any():
        order = np.lexsort((pos, of))
        row, pos, word, null, of = (x[order] for x in (row, pos, word, null, of))

    label_row, label_word, label, label_null = _opened(part, "label")
    words, label_of = np.concatenate((word, label_word)), sentence[label_row]
    low, high = int(words.min(initial=0)), int(words.max(initial=0))
    if (high - low + 1) * (len(sentence) + 1) < 1 << 62:
        asked, there = of * (high - low + 1) + (word - low), label_of * (high - low + 1) + (label_word - low)
    else:   # far apart: by rank
        ranks, rank = np.unique(words, return_inverse=True)
        asked, there = of * len(ranks) + rank[:len(word)], label_of * len(ranks) + rank[len(word):]
    if (there[1:] < there[:-1]).any():
        order = np.argsort(there, kind="stable")
        there, label, label_null = there[order], label[order], label_null[order]
    at = np.searchsorted(there, asked)
    found = np.where(null, 0, np.searchsorted(there, asked, "right") - at)
    if found.max(initial=0) > 1:   # a row for each label, as a join gives
        times = np.maximum(found, 1)
        every = np.repeat(np.arange(len(times)), times)
        at = at[every] + np.arange(len(every)) - np.repeat(np.cumsum(times) - times, times)
        row, pos, word, null, of, found = (x[every] for x in (row, pos, word, null, of, found))
    skip = null.copy()
    skip[1:] |= (of[1:] == of[:-1]) & ~null[:-1] & (word[1:] == word[:-1])
    at = np.where(found > 0, at, len(label))   # the last one stands for no label
    label, label_null = np.append(label, 0)[at], np.append(label_null, True)[at]
    nowhere = part.column("_first").is_null().to_numpy(zero_copy_only=False)
    return pa.RecordBatch.from_arrays(
        [*[part.column(k).take(pa.array(row)) for k in keys], pa.array(pos, mask=nowhere[row]), pa.array(word, mask=null),
         pa.array(np.where(skip, IGNORE_INDEX, label), mask=label_null & ~skip)], names=[*keys, "_pos", "_word", "_label"])


def first_subwords(df: DataFrame, keys: list[str], pos_col: str, word_col: str) -> DataFrame:
    """Inference walk: rows of the first piece of each word (nulls skipped
    without resetting the previous word)."""
    w = Window.partitionBy(*keys).orderBy(pos_col)
    nn = df.where(F.col(word_col).isNotNull())
    return (nn.withColumn("_prev", F.lag(word_col).over(w))
            .where(~F.col("_prev").eqNullSafe(F.col(word_col))).drop("_prev"))


def pass_through(df: DataFrame, added: list[str]) -> tuple[list[str], str]:
    """Columns that a plug-in hands on untouched, and their schema."""
    keep = [f for f in df.schema.fields if f.name not in added]
    return [f.name for f in keep], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)


def encode_batches(df: DataFrame, tokens_col: str,
                   encoder_factory: Callable[[], Callable[[list[list[str]]], tuple[list, list]]]) -> DataFrame:
    """User sub-word encoder through ``mapInArrow``: all columns pass through,
    ``input_ids`` and ``word_ids`` are added. The factory runs once per task;
    the encoder gets a batch of pre-split sentences and returns their ids and
    word indexes: lists with None at special positions, or integer arrays with
    -1 there. Sentences stay whole: align (``align_labels``), then cut
    (``windows``)."""
    import pyarrow as pa

    keep, schema = pass_through(df, ["input_ids", "word_ids"])

    def run(batches):
        encode = encoder_factory()
        for rb in bounded(batches, tokens_col):
            ids, words = encode(lists(rb.column(tokens_col)))
            yield pa.RecordBatch.from_arrays([*[rb.column(k) for k in keep], int_lists(ids), int_lists(words, -1)],
                                             names=[*keep, "input_ids", "word_ids"])

    ship_package(df.sparkSession)
    return df.mapInArrow(run, f"{schema}, input_ids array<int>, word_ids array<int>")
