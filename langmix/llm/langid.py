"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram binds the vectors of
its letters by product, after one is shifted twice and one once, so that order
counts. A text is the bundle (sum) of its trigrams, a language the bundle of
its training texts, and a text gets the language with the largest cosine.

Letters are lower-cased; runs of other characters count as one space, and a
text starts and ends with a space, so one letter is enough. Letters beyond a to
z share 37 symbols by code point. Texts that are null or have no letter get
``und`` and score 0; ties go to the language first in the alphabet. The score
is the cosine, at least 0. Prototypes come from at most about
``TRAIN_PER_LANG`` rows of each language, which may be null or missing in any
other row; without training rows every text is ``und``. Repeated rows are
predicted each. Other columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm.common import bounded_sample, fold, table
from langmix.llm.worker import cached, tidy
from langmix.session import ship_package

DIM = 1024
SYMBOLS = 64             # 0: not a letter, 1 to 26: a to z, else other letters
TRAIN_PER_LANG = 3000
SEED = 11
UNKNOWN = "und"
QUANTUM = 1000           # a training text adds its unit vector in these steps, so sums are exact


class Space:
    """Letter vectors and the trigram vectors made of them so far."""

    def __init__(self):
        import numpy as np

        rng = np.random.default_rng(SEED)
        self.letters = rng.integers(0, 2, (SYMBOLS, DIM), dtype=np.int8) * 2 - 1
        self.symbol = np.zeros(0x110000, np.uint8)
        for code in range(len(self.symbol)):
            if chr(code).isalpha():
                self.symbol[code] = code - 96 if 97 <= code <= 122 else 27 + code * 2654435761 % 4294967291 % 37
        self.grams = np.zeros((SYMBOLS**3, DIM), np.int8)
        self.made = np.zeros(SYMBOLS**3, bool)

    def codes(self, text: str):
        """(distinct trigram codes, counts); empty without a letter."""
        import numpy as np

        points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
        s = self.symbol[points].astype(np.int64)
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        if len(s) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
        if len(codes) > 1 << 16:
            counts = np.bincount(codes, minlength=SYMBOLS**3)
            codes = np.flatnonzero(counts)
            return codes, counts[codes]
        return np.unique(codes, return_counts=True)

    def bundle(self, text: str):
        """The text's vector, or None without a letter."""
        import numpy as np

        codes, counts = self.codes(text)
        if not len(codes):
            return None
        new = codes[~self.made[codes]]
        if len(new):
            a, b, c = new // SYMBOLS**2, new // SYMBOLS % SYMBOLS, new % SYMBOLS
            self.grams[new] = (np.roll(self.letters[a], 2, 1) * np.roll(self.letters[b], 1, 1) * self.letters[c])
            self.made[new] = True
        return counts.astype(np.float32) @ self.grams[codes].astype(np.float32)


def space() -> Space:
    return cached("langid", Space)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        per_lang: int = TRAIN_PER_LANG):
    """(languages, unit prototypes) from a bounded sample of the rows given."""
    import numpy as np

    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
                       F.col(f"`{text_col}`").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sample = bounded_sample(rows, "lang", per_lang, "id", SEED).select("lang", "text")

    def run(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                v = space().bundle(text.as_py())
                if v is not None and (norm := float(np.linalg.norm(v))) > 0:
                    add = np.rint(QUANTUM * v.astype(float) / norm).astype(np.int64)
                    sums[lang.as_py()] = sums.get(lang.as_py(), 0) + add
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()),
                                          pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))],
                                         names=["lang", "part"])

    parts = sample.mapInArrow(tidy(run, "langid"), "lang string, part array<bigint>")
    got = (parts.select("lang", F.posexplode("part").alias("i", "x")).groupBy("lang", "i")
           .agg(F.sum("x").alias("x")).collect())  # DIM numbers a language
    langs = sorted({r["lang"] for r in got})
    protos = np.zeros((len(langs), DIM))
    for r in got:
        protos[langs.index(r["lang"]), r["i"]] = r["x"]
    norms = np.linalg.norm(protos, axis=1, keepdims=True)
    return langs, protos / np.where(norms == 0, 1, norms)


def predict(docs: DataFrame, model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every whole text."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        langs, protos = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column("_text"):
                v = space().bundle(text.as_py()) if langs and text.is_valid else None
                norm = float(np.linalg.norm(v)) if v is not None else 0.0
                if norm == 0.0:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cos = protos @ v.astype(float) / norm
                best = int(cos.argmax())
                names.append(langs[best])
                scores.append(min(1.0, max(0.0, float(cos[best]))))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keep))], pa.array(names, pa.string()),
                 pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
                       + ["lang_pred string", "score double"])
    return src.mapInArrow(tidy(run, "langid"), schema)


def op1_hyperdimensional_langid(spark, sf_dir):
    """Language of every whole document, learned from the folds not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 3) != 1))
    got = predict(docs.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out")), model,
                  keep=("doc_id", "held_out"))
    return got.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op1_hyperdimensional_langid": op1_hyperdimensional_langid}
SQL: dict[str, str] = {}
