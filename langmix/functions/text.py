"""Text rules as native Column expressions (no Python UDF).

Java regex differs from Python's ``re`` in a few places; every pattern here is
written so that Spark (Java) gives the same answer Python would:
``(?U)`` for Unicode ``\\s``/``\\d``/``\\b``, an explicit class for the four
information separators Python counts as whitespace, ``(?d)`` so ``.`` stops
only at ``\\n``, and ``$1`` in replacements.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
# Characters Python's str.strip()/str.split() treat as whitespace.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Regex class body for the same set (Java (?U)\s lacks U+001C..U+001F).
_WS = r"\s\x1c-\x1f"
WS_RUN = rf"(?U)[{_WS}]+"
# Python universal newlines: \r\n, \r or \n. One character class first, so that
# a place without a line break costs one test.
LINE_BREAK = r"[\r\n](?:(?<=\r)\n)?"

# clean_text rules, in the order they are applied.
CAMEL_START = r"^[A-Z][a-z0-9]+[A-Z]"
DATE_STAMP = r"(?U)\(\d{2}/\d{2}/\d{4}\)"
CLOCK_STAMP = rf"(?iU)\[\d{{1,2}}:\d{{2}}[{_WS}]*(?:AM|PM|PETANG|PAGI|MALAM)?\]"
URL = rf"(?U)http[^{_WS}]+|www[^{_WS}]+"
MENTION = rf"(?U)@[^{_WS}]+"
HASHTAG = rf"(?U)#([^{_WS}]+)"
LONG_DIGITS = r"(?U)\b\d{10,12}\b"
MY_PHONE = r"(?U)(\+6)?01\d-?\d{7,8}"
SYMBOLS = r"[~=+/|]"
ELLIPSIS = r"\.{2,}"
PUNCT_CHARS = ".,!?()\\[\\]{};:\"”“\\-"   # as a regex class body
PUNCT = f"([{PUNCT_CHARS}])"
# The reference also deletes a literal "(@)" right after MENTION; MENTION has
# already consumed "@)" by then, so that rule can never fire and is omitted.
CAMEL_MAX_TOKENS = 5
MIN_TOKENS = 4

# normalize_text rules.
TAG = r"(?d)<.*?>"
NOT_ASCII_LETTER_OR_WS = rf"(?U)[^a-zA-Z{_WS}]"

PROMPT_PREFIX = "task: tag "
# -----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.trim(_c(c), F.lit(WHITESPACE_CHARS))


def is_blank(c) -> Column:
    """``strip_ws(c) == ""``, told by the first character that is no whitespace."""
    return F.ltrim(_c(c), F.lit(WHITESPACE_CHARS)) == ""


def squeeze_ws(c) -> Column:
    """``' '.join(s.split())``."""
    return F.trim(F.regexp_replace(_c(c), WS_RUN, " "))


def split_ws(c) -> Column:
    """Python ``str.split()``: tokens between whitespace runs, no empties.
    Written without a lambda (strip, then split) so it stays inside
    whole-stage codegen."""
    s = strip_ws(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, WS_RUN))


def split_squeezed(c) -> Column:
    """Tokens of text already squeezed to single spaces (clean_text output):
    a plain one-character split, no whitespace regex."""
    c = _c(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def split_lines(c) -> Column:
    """Lines as Python text mode yields them (``\\n``, ``\\r``, ``\\r\\n``)."""
    return F.split(_c(c), LINE_BREAK)


def token_count_squeezed(c) -> Column:
    """Token count of a string already squeezed to single spaces."""
    c = _c(c)
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, " ")))


# The rewrite rules in reference order: (pattern, replacement).
RULES = [
    (DATE_STAMP, " "),
    (CLOCK_STAMP, " "),
    (URL, ""),
    (MENTION, ""),
    (HASHTAG, "$1"),
    (LONG_DIGITS, ""),
    (MY_PHONE, ""),
    (SYMBOLS, " "),
    (ELLIPSIS, " ... "),
    (PUNCT, " $1 "),
]
SYMBOL_CHARS = "~=+/|"  # SYMBOLS as a regex class body
# What the last rules leave between spaces: SYMBOLS become spaces, PUNCT gets
# spaces around it, and runs of whitespace become one space.
TOKEN = rf"(?U)[^{_WS}{SYMBOL_CHARS}{PUNCT_CHARS}]+|[{PUNCT_CHARS}]"


def rule_steps() -> list[tuple]:
    """The same rules up to ELLIPSIS, without SYMBOLS, as ``(guard, rewrite)``
    steps for a row operator that keeps the current text in a column between
    steps; the tokens of what they leave (:func:`clean_tokens`) are those of
    :func:`clean_core`. ``guard(t, digit)``
    is a cheap test on the current text ``t`` (``digit``: the raw line holds
    a digit; earlier rules only delete text or insert spaces and dots, so
    they never create one); the rule runs only where it can match. SYMBOLS
    can wait: a symbol is no dot, so ELLIPSIS finds the same runs."""
    def rr(pattern, replacement):
        return lambda t: F.regexp_replace(t, pattern, replacement)

    return [
        (lambda t, d: t.contains("("), rr(DATE_STAMP, " ")),
        (lambda t, d: t.contains("["), rr(CLOCK_STAMP, " ")),
        (lambda t, d: t.contains("http") | t.contains("www"), rr(URL, "")),
        (lambda t, d: t.contains("@"), rr(MENTION, "")),
        (lambda t, d: t.contains("#"), rr(HASHTAG, "$1")),
        (lambda t, d: d, rr(LONG_DIGITS, "")),
        (lambda t, d: d, rr(MY_PHONE, "")),
        (lambda t, d: t.contains(".."), rr(ELLIPSIS, " ... ")),
    ]


def clean_tokens(c) -> Column:
    """Tokens of a text that :func:`rule_steps` rewrote, in one scan: SYMBOLS,
    PUNCT and the squeeze of whitespace only decide where tokens end."""
    return F.regexp_extract_all(_c(c), F.lit(TOKEN), F.lit(0))


def clean_core(c) -> Column:
    """The rewriting part of clean_text (rules applied in reference order),
    without the discard decisions. Returns the squeezed text."""
    t = _c(c)
    for pattern, replacement in RULES:
        t = F.regexp_replace(t, pattern, replacement)
    return F.trim(F.regexp_replace(t, WS_RUN, " "))


def camel_discard(c) -> Column:
    """Pre-check on the raw text: a short line starting like camelCase.
    The cheap regex runs first; the token count only when it matched."""
    raw = _c(c)
    return F.coalesce(
        raw.rlike(CAMEL_START) & (F.size(split_ws(raw)) < CAMEL_MAX_TOKENS), F.lit(False))


def clean_text(c, min_tokens: int = MIN_TOKENS) -> Column:
    """clean_text as one Column: ``""`` for discarded or non-string input."""
    raw = _c(c)
    t = clean_core(raw)
    return (
        F.when(raw.isNull(), F.lit(""))
        .when(camel_discard(raw), F.lit(""))
        .when(token_count_squeezed(t) < min_tokens, F.lit(""))
        .otherwise(t)
    )


def normalize_text(c) -> Column:
    """normalize_text: lower, drop tags, keep ASCII letters and whitespace,
    squeeze. (The reference's leading strip cannot change the result.)"""
    t = F.lower(_c(c))
    # the tag regex runs only where a '<' exists (the lowered text is a
    # common subexpression of the guard and both branches)
    t = F.when(t.contains("<"), F.regexp_replace(t, TAG, "")).otherwise(t)
    # deleting a run at once equals deleting each of its characters
    t = F.regexp_replace(t, NOT_ASCII_LETTER_OR_WS + "+", "")
    return F.trim(F.regexp_replace(t, WS_RUN, " "))


def normalizes_to_text(c) -> Column:
    """``normalize_text(c) != ''``, for single tokens: without a tag to drop,
    one scan for a letter tells."""
    t = F.lower(_c(c))
    return F.when(t.contains("<"), normalize_text(c) != "").otherwise(t.rlike("[a-z]"))


def prompt(c) -> Column:
    """Prompt prefix used by the sequence-to-sequence tagger."""
    return F.concat(F.lit(PROMPT_PREFIX), _c(c))


def digest(c) -> Column:
    """128 bits that stand for a text as a join or aggregation key: two 64-bit
    hashes under different seeds, null for null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNotNull(), F.struct(F.xxhash64(x).alias("hi"), F.xxhash64(F.lit(1), x).alias("lo")))
