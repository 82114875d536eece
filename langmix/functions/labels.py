"""Label vocabulary and label-bearing string formats, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from langmix.functions.text import strip_ws

# --- Fixed values -----------------------------------------------------------
ID2LABEL = {0: "O", 1: "MS", 2: "EN"}
LABEL2ID = {"O": 0, "MS": 1, "EN": 2}
DISPLAY = {0: "Other", 1: "Malay", 2: "English"}
IGNORE_INDEX = -100
ITEM_SEPARATOR = " | "   # between items of a decoded tagged string
ARROW = "->"             # between token and label inside an item
SKIP_TOKEN = "tag"       # echoed task word, dropped when parsing
ENG_MARK = "ENG"         # label text containing this -> EN
MAL_MARK = "MAL"         # label text containing this -> MS
# -----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label_id(tag) -> Column:
    """Word-tagger output -> id: EN -> 2, MS -> 1, anything else (or null) -> 0."""
    t = _c(tag)
    return (F.when(t == "EN", F.lit(LABEL2ID["EN"]))
            .when(t == "MS", F.lit(LABEL2ID["MS"]))
            .otherwise(F.lit(LABEL2ID["O"])))


def label_name(label) -> Column:
    """Id -> short name (O / MS / EN); null for ids outside the vocabulary."""
    return F.element_at(F.create_map(*[x for k, v in ID2LABEL.items() for x in (F.lit(k), F.lit(v))]),
                        _c(label))


def label_display(label) -> Column:
    return F.element_at(F.create_map(*[x for k, v in DISPLAY.items() for x in (F.lit(k), F.lit(v))]),
                        _c(label))


def parse_tagged(decoded) -> Column:
    """Parse ``"[tok] -> LABEL | tok -> LABEL"`` into
    ``array<struct<token string, label_id int>>``.

    Items without ``->`` are ignored; the label is the text between the first
    and second arrow, upper-cased; ``ENG`` anywhere -> 2, else ``MAL`` -> 1,
    else 0; tokens equal to ``tag`` (any case) or empty are dropped."""
    items = F.filter(F.split(_c(decoded), r" \| "), lambda it: it.contains(ARROW))

    # cut at the arrows' places: a split would compile its pattern for every item
    def to_pair(it):
        before = F.substring_index(it, ARROW, 1)
        token = strip_ws(F.replace(F.replace(before, F.lit("["), F.lit("")), F.lit("]"), F.lit("")))
        label = F.upper(F.substring_index(F.substring_index(it, ARROW, 2), ARROW, -1))
        lid = (F.when(label.contains(ENG_MARK), F.lit(2))
               .when(label.contains(MAL_MARK), F.lit(1)).otherwise(F.lit(0)))
        return F.struct(token.alias("token"), lid.alias("label_id"))

    pairs = F.transform(items, to_pair)
    return F.filter(pairs, lambda p: (F.lower(p["token"]) != SKIP_TOKEN) & (p["token"] != ""))


def annotate(tokens, labels, marks: dict[int, str] | None = None) -> Column:
    """Inline-tagged text: ``tok(MS)`` / ``tok(EN)`` / ``tok``, space-joined.
    ``marks`` gives other templates by label id, with ``{t}`` for the token.
    Pairs stop at the shorter list, like Python ``zip``."""
    tokens, labels = _c(tokens), _c(labels)
    n = F.least(F.size(tokens), F.size(labels))
    marks = marks or {LABEL2ID[k]: f"{{t}}({k})" for k in ("MS", "EN")}

    def one(t, lab):
        out = t
        for label, template in marks.items():
            before, after = template.split("{t}")
            out = F.when(lab == label, F.concat(F.lit(before), t, F.lit(after))).otherwise(out)
        return out

    pieces = F.slice(F.zip_with(tokens, labels, one), 1, n)
    return strip_ws(F.array_join(pieces, " "))


def format_tagged(tokens, labels, names: dict[int, str]) -> Column:
    """Build a decoded tagged string ``[tok] -> NAME | ...`` (test/binding aid)."""
    tokens, labels = _c(tokens), _c(labels)
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    items = F.zip_with(tokens, labels,
                       lambda t, lab: F.concat(F.lit("["), t, F.lit("] -> "), F.element_at(m, lab)))
    return F.array_join(items, ITEM_SEPARATOR)
