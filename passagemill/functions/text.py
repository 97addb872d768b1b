"""Column helpers for text. All of them are built-in expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() treats as blank.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Sentence end followed by blanks, word characters, the control mark used to cut.
SENTENCE_END = r"([.!?])[ \t\n\r\f]+"
WORD = r"[\p{L}\p{N}]+"
CUT = "\x01"
CHARS_PER_TOKEN = 4


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def format_text(text: Column) -> Column:
    """Newlines become spaces, then both ends are stripped."""
    return strip(F.replace(text, F.lit("\n"), F.lit(" ")))


def char_count(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    """Pieces of a split on one space; empty text counts as one."""
    return F.size(F.split(text, " "))


def raw_sentence_count(text: Column) -> Column:
    """Pieces of a split on dot-space."""
    return F.size(F.split(text, r"\. "))


def token_count(text: Column) -> Column:
    """Rough model tokens: characters over four, not rounded."""
    return F.length(text) / F.lit(float(CHARS_PER_TOKEN))


def sentences(text: Column) -> Column:
    marked = F.regexp_replace(text, SENTENCE_END, "$1" + CUT)
    return F.filter(F.split(marked, CUT), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n+"), strip), lambda s: s != "")


def piece(items: Column, start: Column, size: int) -> Column:
    """``size`` elements from one-based ``start``, read by place; ``slice`` copies the whole array."""
    last = F.least(start + (size - 1), F.size(items))
    return F.transform(F.sequence(start, last), lambda i: F.get(items, i - 1))


def grouped(items: Column, size: int = 10) -> Column:
    """Slices of ``size`` consecutive elements, the last one short; empty in, empty out."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(size)))
    return F.when(
        items.isNotNull(),
        F.coalesce(F.transform(starts, lambda i: piece(items, i, size)), F.array()),
    )


def joined_chunk(group: Column, joiner: str = "") -> Column:
    """Sentences glued together, double spaces halved once, a blank put after a glued full stop."""
    text = F.array_join(group, joiner)
    text = strip(F.replace(text, F.lit("  "), F.lit(" ")))
    return F.regexp_replace(text, r"\.([A-Z0-9])", ". $1")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def normalised_key(text: Column) -> Column:
    return strip(F.lower(text))


def hash_order(seed: str, *key: Column) -> Column:
    """Sampling order that is the same on every run."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key]))
