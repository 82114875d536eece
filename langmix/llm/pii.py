"""Personal data by weak supervision.

Candidates of four kinds (email, ip, card, phone) come from the strict rules
below and from looser ones: written-out or bracketed addresses, defanged IPs,
card numbers inside longer runs of digits or with other separators, phones
without a plus. Labelers vote for, against or not at all on each: the strict
rule (pattern and checks), a gazetteer (top-level domains, card issuers,
calling codes, reserved addresses), the words before it, the characters around
it, and how varied it is. Expectation-maximisation estimates per kind how
often each labeler votes which way on real and on false candidates, from the
counts of all vote patterns of all documents; no truth is given. The resulting
probabilities train a span classifier on shape and context (a logistic
regression on hashed features), which never sees the votes.

A strict span always stays. Any other is added if the classifier's probability
reaches ``KEEP`` and the estimate from its votes agrees, where it overlaps no
strict span of any kind; of overlapping ones the most probable stays (then the
first, then the longer).

Strict rules, leftmost and without overlaps for each kind, in code points:
email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (9 to 15
digits). A match that fails its check goes and isn't tried again. Every scan is
linear in the text, whatever it repeats.

Null and empty texts have no spans; repeated rows are searched each; extra
columns pass through, and ``spans`` replaces a column of that name. Vote
patterns are counted over all candidates; the classifier learns from about
``TRAIN_SPANS`` candidates of every kind. Empty tables, and tables without a
candidate, have nothing to learn from and give no more than strict spans."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, insort
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm.common import land, table, without
from langmix.llm.worker import slices, tidy
from langmix.session import ship_package

KINDS = ("email", "ip", "card", "phone")
TRAIN_SPANS = 20_000     # candidates of a kind that the classifier learns from, at most about
BUCKETS = 1 << 12        # hashed features of the classifier
EPOCHS = 6
RATE = 0.5
KEEP = 0.9
BEFORE = 48              # characters before a span in which its context is looked up
ROUNDS = 60
SEED = 41

# --- Fixed values of the strict rules ------------------------------------------------
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# --------------------------------------------------------------------------------------

_DOMAIN = re.compile(DOMAIN)
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(CARD)
_PHONE = re.compile(PHONE)
_DIGITS = re.compile("[0-9]").findall
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def strict(text: str):
    """(spans of each kind by the strict rules, failed matches of cards)."""
    emails, ips, cards, phones, failed = [], [], [], [], []
    at, end = text.find("@"), 0
    while at >= 0:   # a local part can't hold an @, so it is what stands right before one
        start = end + len(text[end:at].rstrip(LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            emails.append((start, found.end()))
        end = found.end() if found else at + 1
        at = text.find("@", end)
    if "." in text:
        for m in _CHAIN.finditer(text):   # a run of numbers between dots; every four are a match
            if m.group().count(".") < 3:
                continue
            part, place = m.group().split("."), m.start()
            for i in range(0, len(part) - 3, 4):
                four = part[i:i + 4]
                if all(map(_small, four)):
                    ips.append((place, place + sum(map(len, four)) + 3))
                place += sum(map(len, four)) + 4
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            (cards if 13 <= len(digits) <= 19 and luhn(digits) else failed).append(m.span())
    if "+" in text:
        phones = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGITS(m.group())) <= 15]
    return (emails, ips, cards, phones), failed


# --- looser candidates ----------------------------------------------------------------

_AT = re.compile(r"\s?(?:\(at\)|\[at\]|\{at\})\s?|@", re.I)
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?)"
_LOOSE_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{0,8}}", re.I)
_LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\s?[\[(]dot[\])]\s?)[0-9]{1,3}){3}(?![0-9])", re.I)
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,3}[0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{4}[ ./_-]{1,3}[0-9]{6}[ ./_-]{1,3}[0-9]{5}(?![0-9])")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")


def loose(text: str, failed) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the looser rules."""
    out, end = [], 0
    if "@" in text or "at)" in text.lower() or "at]" in text.lower() or "at}" in text.lower():
        for m in _AT.finditer(text):
            start = end + len(text[end:m.start()].rstrip(LOCAL))
            found = _LOOSE_DOMAIN.match(text, m.end()) if start < m.start() else None
            if found:
                out.append((0, start, found.end()))
            end = m.end()
    if any(c in text for c in "[("):
        out += [(1, *m.span()) for m in _LOOSE_IP.finditer(text)]
    out += [(2, *m.span()) for m in _LOOSE_CARD.finditer(text)]
    for a, b in failed:   # the first groups of a longer run that could be a number of their own
        groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", text[a:b])]
        digits = 0
        for i, (x, y) in enumerate(groups):
            digits += y - x
            if digits > 19:
                break
            if digits >= 13 and i + 1 < len(groups):
                out.append((2, a, a + y))
    out += [(3, *m.span()) for m in _LOOSE_PHONE.finditer(text)]
    return out


# --- labelers -------------------------------------------------------------------------

TOP_LEVEL = frozenset("com org net edu gov mil int info biz name pro eu io co app dev".split())
CUES = {"email": ("mail", "contact", "write", "courriel", "correo", "kontakt", "reach"),
        "ip": ("ip", "host", "server", "address", "adresse", "login", "from"),
        "card": ("card", "visa", "credit", "carte", "tarjeta", "karte", "pay", "amex", "mastercard"),
        "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "telefon", "appel", "llam", "whatsapp")}
AGAINST = ("version", "isbn", "issn", "order", "invoice", "ref", "no.", "nr", "id", "release", "serial", "sku", "date", "v.")
_WORD = re.compile(r"[^\W\d_]+\.?")


def _gazetteer(kind: str, span: str) -> int:
    digits = _NOT_DIGIT.sub("", span)
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]} "))[-1].lower()
        return 1 if last in TOP_LEVEL or (len(last) == 2 and last.isalpha()) else -1
    if kind == "ip":
        parts = [int(x[-4:]) for x in re.findall("[0-9]+", span)]
        return -1 if parts[0] == 0 or parts[0] >= 240 or max(parts) < 10 or max(parts) > 255 else 1
    if kind == "card":
        two, four, n = int(digits[:2]), int(digits[:4]), len(digits)
        known = (digits[0] == "4" and n in (13, 16, 19)) or (n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720)) \
            or (n == 15 and two in (34, 37)) or (n in (16, 19) and (four == 6011 or two in (62, 65, 35))) \
            or (n == 14 and two in (36, 38, 30))
        return 1 if known else -1
    if span[0] == "+":
        return -1 if digits[0] == "0" else 1
    return -1 if re.match(r"(?:19|20)[0-9]{2}[ .-]", span) else 1 if span.startswith(("(", "00")) else 0


def _context(kind: str, before: str) -> int:
    words = [w.lower() for w in _WORD.findall(before)][-4:]
    if any(w.startswith(c) for w in words for c in CUES[kind] if len(c) > 2 or w == c):
        return 1
    return -1 if any(w == c or (len(c) > 3 and w.startswith(c)) for w in words for c in AGAINST) else 0


def votes(kind: int, text: str, start: int, end: int, is_strict: bool) -> tuple[int, ...]:
    """Votes of the labelers, each -1, 0 or 1: rule, gazetteer, context, surroundings, variety."""
    name, span = KINDS[kind], text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    rule = 1 if is_strict else 0
    if not is_strict and name == "card":
        rule = 1 if luhn(digits) else -1
    if not is_strict and name == "email":
        rule = 0 if re.search(r"\.|dot", span[span.find("@") + 1:], re.I) else -1
    around = text[start - 1:start] + text[end:end + 1]
    edge = -1 if any(c.isalnum() or c in "_=/#@" for c in around) else 1
    if name == "email":
        local = re.split(r"[\s(\[{@]", span)[0]
        varied = 1 if 2 <= len(local) <= 64 and len(set(local)) > 1 else -1
    else:
        varied = 1 if len(set(digits)) > max(2, len(digits) // 6) else -1
    return rule, _gazetteer(name, span), _context(name, text[max(0, start - BEFORE):start]), edge, varied


LABELERS = 5
_SHAPE = str.maketrans({**{c: "0" for c in "0123456789"}, **{c: "x" for c in LOCAL if c.isalpha()}})


def features(kind: int, text: str, start: int, end: int) -> list[int]:
    """Hashed features of a candidate: shape, lengths, pieces, words around it."""
    span = text[start:end]
    shape = span.translate(_SHAPE)
    parts = re.split(r"[^A-Za-z0-9]+", span.lower())
    left = [w.lower() for w in _WORD.findall(text[max(0, start - BEFORE):start])][-2:]
    right = [w.lower() for w in _WORD.findall(text[end:end + BEFORE])][:1]
    found = [f"kind {kind}", "shape " + re.sub(r"(.)\1+", r"\1\1", shape)[:40], "begins " + shape[:3], "ends " + shape[-3:],
             f"digits {shape.count('0')}", f"groups {len(parts)}", "first " + parts[0][:2], "last " + parts[-1][-3:],
             "signs " + "".join(sorted(set(_SIGNS.findall(span)))),
             f"near {text[start - 1:start].isalnum()} {text[end:end + 1].isalnum()}", *[f"left {w}" for w in left],
             *[f"right {w}" for w in right]]
    return [zlib.crc32(f"{kind} {x}".encode("utf-8", "replace")) % BUCKETS for x in found]


_SIGNS = re.compile(r"[^A-Za-z0-9]")


def candidates(text: str | None) -> list[tuple[int, int, int, bool, str, list[int]]]:
    """(kind, start, end, strict, votes as text, features) of a text."""
    if not text:
        return []
    by_kind, failed = strict(text)
    found = [(k, a, b, True) for k, spans in enumerate(by_kind) for a, b in spans]
    starts = sorted(a for _, a, _, _ in found)
    reach = list(accumulate((b for _, b in sorted((a, b) for _, a, b, _ in found)), max))   # farthest end so far
    extra = []
    for k, a, b in dict.fromkeys(loose(text, failed)):
        before = bisect_left(starts, b)   # strict spans that begin before the candidate's end
        if not before or reach[before - 1] <= a:
            extra.append((k, a, b, False))
    return [(k, a, b, s, "".join("-0+"[v + 1] for v in votes(k, text, a, b, s)), features(k, text, a, b))
            for k, a, b, s in found + extra]


# --- the vote model -------------------------------------------------------------------

#: chances of votes (-, 0, +) on false and on real candidates to start from, as so many seen candidates
_PRIOR = {False: (2.0, 1.5, 0.5), True: (0.5, 1.5, 2.0)}


def reliabilities(counts: dict[str, int], rounds: int = ROUNDS):
    """(share of real candidates, chances[labeler][real][vote]) of one kind by expectation-maximisation over the vote
    patterns' counts."""
    import numpy as np

    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    vote = np.array([["-0+".index(c) for c in p] for p in patterns])
    real = 1 / (1 + np.exp(-1.5 * (vote - 1).sum(1)))
    share, chances = 0.5, np.zeros((vote.shape[1], 2, 3))
    for _ in range(rounds):
        share = float((n @ real + 1) / (n.sum() + 2))
        for j in range(vote.shape[1]):
            for y, weight in ((0, n * (1 - real)), (1, n * real)):
                seen = np.bincount(vote[:, j], weights=weight, minlength=3) + np.array(_PRIOR[bool(y)])
                chances[j, y] = seen / seen.sum()
        real = posterior(vote, share, chances)
    return share, chances


def posterior(vote, share: float, chances):
    """Probability that candidates with these votes (0, 1, 2) are real."""
    import numpy as np

    odds = np.full(len(vote), math.log(share / (1 - share)))
    for j in range(vote.shape[1]):
        odds += np.log(chances[j, 1, vote[:, j]] / chances[j, 0, vote[:, j]])
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Model:
    """Vote chances of each kind, and the classifier's weights."""

    def __init__(self, kinds: dict, weights):
        self.kinds, self.weights = kinds, weights

    def by_votes(self, kind: int, pattern: str) -> float:
        import numpy as np

        if kind not in self.kinds:
            return 0.0
        return float(posterior(np.array([["-0+".index(c) for c in pattern]]), *self.kinds[kind])[0])

    def probability(self, found) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weights[found].sum())))))


def train(rows: list[tuple[list[int], float]]):
    """Logistic weights for (features, probability of being real) by stochastic ascent (AdaGrad)."""
    import numpy as np

    weights, seen, rng = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), np.random.default_rng(SEED)
    rows = [(np.unique(np.array(x)), y) for x, y in rows]
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            x, y = rows[i]
            grad = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, float(weights[x].sum())))))
            seen[x] += grad * grad
            weights[x] += RATE * grad / np.sqrt(seen[x])
    return weights


_FOUND = "array<struct<kind: int, start: int, end: int, strict: boolean, votes: string, features: array<int>>>"


def find_candidates(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) with ``_found``, the candidates of every whole text."""
    ship_package(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    used = list(dict.fromkeys([*keep, text_col]))
    src, text = docs.select(*[F.col(f"`{c}`") for c in used]), used.index(text_col)

    def run(batches):
        import pyarrow as pa

        names = ("kind", "start", "end", "strict", "votes", "features")
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("strict", pa.bool_()),
                                   ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))
        for batch in slices(batches):
            found = [[dict(zip(names, c)) for c in candidates(x.as_py())] for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(found, kind)], names=[*keep, "_found"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return src.mapInArrow(tidy(run), ", ".join([*fields, f"_found {_FOUND}"]))


def fit(found: DataFrame, train_spans: int = TRAIN_SPANS) -> Model:
    """Reliabilities from the counts of all vote patterns, and the classifier."""
    one = found.select(F.explode("_found").alias("c")).select("c.kind", "c.votes", "c.features")
    counts = one.groupBy("kind", "votes").count().collect()   # 3 to the power of LABELERS patterns of a kind
    kinds = {}
    for k in {r["kind"] for r in counts}:
        kinds[k] = reliabilities({r["votes"]: r["count"] for r in counts if r["kind"] == k})
    model = Model(kinds, None)
    total = {k: sum(r["count"] for r in counts if r["kind"] == k) for k in kinds}
    if total:
        share = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(total.items())
                                            for x in (k, min(1.0, train_spans / n))]), F.col("kind"))
        one = one.where(F.rand(SEED) < share)
    rows = sorted((r["kind"], r["votes"], list(r["features"])) for r in one.collect()) if total else []
    model.weights = train([(f, model.by_votes(k, v)) for k, v, f in rows])
    return model


def chosen(found: list[dict], model: Model, keep: float = KEEP) -> list[dict]:
    """Strict spans and the added ones, by kind and place."""
    out = [{"kind": KINDS[c["kind"]], "start": c["start"], "end": c["end"], "strict": True,
            "probability": model.probability(c["features"])} for c in found if c["strict"]]
    more = [(model.probability(c["features"]), c) for c in found if not c["strict"]]
    taken: list[tuple[int, int]] = []   # by place; none overlaps another
    for p, c in sorted(more, key=lambda x: (-x[0], x[1]["start"], -x[1]["end"], x[1]["kind"])):
        at = bisect_left(taken, (c["end"],))
        if p >= keep and model.by_votes(c["kind"], c["votes"]) >= keep and (not at or taken[at - 1][1] <= c["start"]):
            insort(taken, (c["start"], c["end"]))
            out.append({"kind": KINDS[c["kind"]], "start": c["start"], "end": c["end"], "strict": False, "probability": p})
    return sorted(out, key=lambda s: (KINDS.index(s["kind"]), s["start"], s["end"]))


def choose(found: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """``spans`` (kind, start, end in code points, strict, probability) in place of the candidates."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in found.columns if c != "_found"]
    place = found.columns.index("_found")

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("strict", pa.bool_()),
                                   ("probability", pa.float64())]))
        for batch in batches:
            spans = [chosen(x, shared.value, keep) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(spans, kind)], names=[*rest, "spans"])

    fields = [f"`{c}` {found.schema[c].dataType.simpleString()}" for c in rest]
    return found.mapInArrow(tidy(run), ", ".join(
        [*fields, "spans array<struct<kind: string, start: int, end: int, strict: boolean, probability: double>>"]))


def detect(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) with ``spans``. Texts are read once: their candidates are written, counted and
    learned from."""
    docs = without(docs, "spans", "_found")
    found = land(find_candidates(docs, text_col, keep), "pii-candidates")
    return choose(found, fit(found))


def op11_weak_supervision_pii(spark, sf_dir):
    """Strict counts and digest, and all spans, of every whole document."""
    got = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["strict"])
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return got.select("doc_id", *map(count, KINDS),
                      F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op11_weak_supervision_pii": op11_weak_supervision_pii}
SQL: dict[str, str] = {}
