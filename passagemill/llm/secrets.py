"""Secrets in texts: known forms, and strings whose sliding windows have a high Shannon entropy.

Three known forms are found by pattern alone (``assign``, ``access``, ``hex``). Beyond them, every run of 20 or more letters, digits, ``+``,
``/``, ``_`` and ``-`` is a candidate. It belongs to the narrowest character class that holds it (hexadecimal, alphanumeric, base64),
and a window slides over it: the character that enters and the one that leaves change two counts, and the sum of n log n over the
counts moves by four entries of a table, so no window is counted anew. The entropy of a window of W characters is log W less
that sum over W; sums are whole millionths, so that every engine compares the same numbers. From the first to the last window at or above
the class's bound the candidate is a secret, unless it is on the allow-list. What a known form has already is no candidate.

All work happens inside the row by column expressions: nothing is shuffled, no Python runs on the executors. Places in a text are
running totals over what lies between matches and the matches, in two levels, so that a text with very many matches stays cheap.

Defined results: a null or empty text has no span; rows that repeat an id or a text are answered one by one; an empty table gives
no rows; a very long text is one row like any other. Columns other than the id and the text are not read, whatever their names.
Places count code points, ends are exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.quality_rules import let


def _either_case(pattern: str) -> str:
    """Letters as classes of both cases: engines differ in what else they fold."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


# The known forms.
ASSIGN = f"({_either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KNOWN = ("assign", "access", "hex")

_MILLION = 1_000_000


class Alphabet(NamedTuple):
    """A class of characters, the width of its window, and the bits a window needs."""

    name: str
    letters: str
    window: int
    bits: float

    @property
    def most(self) -> int:
        """The largest sum of n log n, in millionths, that a window at the bound has."""
        return math.floor(_MILLION * self.window * (math.log2(self.window) - self.bits))


_DIGITS, _SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"
MIN_CANDIDATE = 20
#: From the narrowest to the widest.
ALPHABETS = (
    Alphabet("hexadecimal", _DIGITS + "abcdefABCDEF", MIN_CANDIDATE, 3.0),
    Alphabet("alphanumeric", _DIGITS + _SMALL + _SMALL.upper(), MIN_CANDIDATE, 3.9),
    Alphabet("base64", _DIGITS + _SMALL + _SMALL.upper() + "+/_-", MIN_CANDIDATE, 3.9),
)
CANDIDATE = f"[A-Za-z0-9+/_-]{{{MIN_CANDIDATE},}}"
#: Whole candidates that are no secrets: words and paths, numbers and dates, UUIDs, placeholders, the alphabet.
ALLOWED = (
    "[^0-9]*",
    "[0-9+/_-]*",
    "[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    f".*({_either_case('example|sample|dummy|placeholder|changeme|xxxx')}).*",
    ".*(0123456789|1234567890|abcdefghij|ABCDEFGHIJ).*",
)

SPAN = "struct<start: int, rank: int, end: int, kind: string>"


def steps_of(window: int) -> list[int]:
    """n log2 n in millionths for every count that a window can have."""
    return [round(_MILLION * n * math.log2(n)) if n else 0 for n in range(window + 1)]


def _last(x: Column) -> Column:
    return F.element_at(x, -1)


def running_totals(values: Column) -> Column:
    """Sum of each element and all before it (array of long), by parts of about the root of the length."""
    zero = F.array(F.lit(0).cast("long"))
    add = lambda done, x: F.concat(done, F.array(_last(done) + x))

    def by_parts(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        places = F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1)
        sums = F.transform(places, lambda c: F.aggregate(F.slice(v, c * size + 1, size), zero, add))
        join = lambda s: let(F.aggregate(s, zero, lambda done, x: add(done, _last(x))), lambda b: shifted(s, b))
        return let(sums, join)

    def shifted(sums: Column, before: Column) -> Column:
        return F.flatten(F.transform(sums, lambda s, c: F.transform(F.slice(s, 2, F.size(s) - 1), lambda x: x + F.get(before, c))))

    return let(values, lambda v: F.when(F.size(v) > 0, by_parts(v)).otherwise(F.array().cast("array<bigint>")))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches that do not overlap: array of (start, end, value), ``value`` being the match or one group of it."""
    regex = F.lit(pattern)

    def with_places(gaps: Column, whole: Column) -> Column:
        lengths = F.flatten(F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, m: F.array(F.length(g), F.length(m))))
        value = F.regexp_extract_all(text, regex, F.lit(group)) if group else whole
        span = lambda t, v: F.transform(
            v, lambda x, i: F.struct(F.get(t, 2 * i).cast("int").alias("start"), F.get(t, 2 * i + 1).cast("int").alias("end"), x.alias("value"))
        )
        return let(running_totals(lengths), lambda t: let(value, lambda v: span(t, v)))

    found = let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, regex, F.lit(0)), lambda m: with_places(gaps, m)))
    return F.when(F.rlike(text, regex), found).otherwise(F.array().cast("array<struct<start: int, end: int, value: string>>"))


def _spans(found: Column, kind: Column, rank: Column) -> Column:
    span = lambda x: F.struct(x["start"].alias("start"), rank.alias("rank"), x["end"].alias("end"), kind.alias("kind"))
    return F.transform(found, span)


def known(text: Column) -> list[Column]:
    """Spans of each known form."""
    long_enough = F.filter(located(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= ASSIGN_VALUE)
    found = [long_enough, located(text, ACCESS), located(text, HEX)]
    return [_spans(x, F.lit(KNOWN[i]), F.lit(i)) for i, x in enumerate(found)]


def hot_windows(value: Column, alphabet: Alphabet) -> Column:
    """(first, last): where the first window at the bound starts and the last one ends; nulls without any."""
    width, table = alphabet.window, F.array(*[F.lit(x).cast("long") for x in steps_of(alphabet.window)])
    step = lambda n, by: F.get(table, n + by) - F.get(table, n)
    state = F.struct(
        F.array_repeat(F.lit(0), len(alphabet.letters)).alias("counts"),
        F.lit(0).cast("long").alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def slide(codes: Column) -> Callable[[Column, Column], Column]:
        def moved(s: Column, i: Column) -> Column:
            into, out = F.get(codes, i), F.get(codes, i - width)
            counts = F.when(
                out.isNull() | (into != out),
                F.transform(s["counts"], lambda n, k: n + F.when(k == into, 1).otherwise(0) - F.when(k == out, 1).otherwise(0)),
            ).otherwise(s["counts"])
            leaves = F.when(out.isNull(), F.lit(0)).otherwise(step(F.get(s["counts"], out), -1))
            total = s["sum"] + F.when(into == out, F.lit(0)).otherwise(step(F.get(s["counts"], into), 1) + leaves)
            return let(total, lambda t: judged(s, counts, t, i))

        return moved

    def judged(s: Column, counts: Column, total: Column, i: Column) -> Column:
        hot = (i >= width - 1) & (total <= alphabet.most)
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            F.when(hot & s["first"].isNull(), i - (width - 1)).otherwise(s["first"]).alias("first"),
            F.when(hot, i + 1).otherwise(s["last"]).alias("last"),
        )

    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet.letters), c) - 1)
    places = F.sequence(F.lit(0), F.length(value) - 1)
    return let(codes, lambda c: F.aggregate(places, state, slide(c)))


def _whole(pattern: str) -> Column:
    return F.lit(f"^({pattern})$")


def _is_hot(x: Column, allowed: Sequence[str]) -> Column:
    """False for what a known form has or the allow-list names."""
    other = (ASSIGN, ACCESS, HEX, *allowed)
    names = F.rlike(x, _whole(CANDIDATE))
    for pattern in other:
        names = names & ~F.rlike(x, _whole(pattern))
    return names


def by_entropy(text: Column, allowed: Sequence[str] = ALLOWED, alphabets: Sequence[Alphabet] = ALPHABETS) -> Column:
    """Spans of candidates with a window at the bound of their class."""

    def span(x: Column, rank: int, alphabet: Alphabet) -> Column:
        def placed(hot: Column) -> Column:
            start, end = x["start"] + hot["first"], x["start"] + hot["last"]
            made = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(alphabet.name).alias("kind"))
            return F.when(hot["first"].isNotNull(), made)

        return let(hot_windows(x["value"], alphabet), placed)

    def inside(x: Column) -> Column:
        found = F.lit(None).cast(SPAN)
        for rank, alphabet in reversed(list(enumerate(alphabets, len(KNOWN)))):
            letters = f"[{re.escape(alphabet.letters)}]*"
            found = F.when(F.rlike(x["value"], _whole(letters)), span(x, rank, alphabet)).otherwise(found)
        return found

    # known forms that need more than a candidate's characters are passed over where they stand
    candidates = F.filter(located(text, f"{ASSIGN}|{CANDIDATE}"), lambda x: _is_hot(x["value"], allowed))
    spans = F.filter(F.transform(candidates, inside), lambda s: s.isNotNull())
    return F.when(F.rlike(text, F.lit(CANDIDATE)), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_secrets(docs: DataFrame, allowed: Sequence[str] = ALLOWED, alphabets: Sequence[Alphabet] = ALPHABETS) -> DataFrame:
    """(doc_id, spans) of every row: (start, rank, end, kind) by start, then in the order of the kinds.

    ``allowed`` lists patterns of whole candidates that are no secrets; they do not suppress known forms.
    """
    text = F.coalesce("text", F.lit(""))
    parts = let(text, lambda t: F.array_sort(F.concat(*known(t), by_entropy(t, allowed, alphabets))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), parts.alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the known forms, the checksum of their spans, and all spans as ``kind:start:end``."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(KNOWN))
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in KNOWN],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The same rows in DuckDB's SQL; windows are counted there one by one."""

    def located_sql(name: str, pattern: str, group: int = 0) -> str:
        p = _quoted(pattern)
        return f"""{name}_g AS (SELECT r, unnest(string_split_regex(text, {p})) AS g, generate_subscripts(string_split_regex(text, {p}), 1) AS i
  FROM d WHERE regexp_matches(text, {p})),
{name}_m AS (SELECT r, unnest(regexp_extract_all(text, {p})) AS m, unnest(regexp_extract_all(text, {p}, {group})) AS v,
  generate_subscripts(regexp_extract_all(text, {p}), 1) AS i FROM d WHERE regexp_matches(text, {p})),
{name} AS (SELECT r, v, CAST(sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS stop, length(m) AS n
  FROM {name}_g JOIN {name}_m USING (r, i))"""

    def cases(value: Callable[[Alphabet], str]) -> str:
        return " ".join(f"WHEN regexp_full_match(v, '[{a.letters.replace('-', '')}{'-' * ('-' in a.letters)}]*') THEN {value(a)}" for a in ALPHABETS)

    steps = ", ".join(map(str, steps_of(MIN_CANDIDATE)[1:]))
    barred = " ".join(f"AND NOT regexp_full_match(v, {_quoted(p)})" for p in (ASSIGN, ACCESS, HEX, *ALLOWED))
    same = {a.window for a in ALPHABETS} == {MIN_CANDIDATE}
    assert same, "the SQL has one width of window"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{located_sql("assign", ASSIGN, 2)},
{located_sql("access", ACCESS)},
{located_sql("hex", HEX)},
{located_sql("cand", f"{ASSIGN}|{CANDIDATE}")},
c AS (SELECT row_number() OVER () AS k, r, v, stop - n AS start, CASE {cases(lambda a: _quoted(a.name))} END AS kind,
  CASE {cases(lambda a: str(ALPHABETS.index(a) + len(KNOWN)))} END AS rank, CASE {cases(lambda a: str(a.most))} END AS most
  FROM cand WHERE regexp_full_match(v, {_quoted(CANDIDATE)}) {barred}),
w AS (SELECT k, unnest(range(0, length(v) - {MIN_CANDIDATE - 1})) AS i FROM c),
x AS (SELECT k, i, unnest(string_split(substr(v, CAST(i + 1 AS INTEGER), {MIN_CANDIDATE}), '')) AS ch FROM w JOIN c USING (k)),
y AS (SELECT k, i, sum([{steps}][n]) AS total FROM (SELECT k, i, count(*) AS n FROM x GROUP BY k, i, ch) GROUP BY k, i),
h AS (SELECT r, start + min(i) AS start, rank, start + max(i) + {MIN_CANDIDATE} AS stop, kind FROM y JOIN c USING (k)
  WHERE total <= most GROUP BY k, r, start, rank, kind),
s AS (SELECT r, stop - n AS start, 0 AS rank, stop, 'assign' AS kind FROM assign WHERE length(v) >= {ASSIGN_VALUE}
  UNION ALL SELECT r, stop - n, 1, stop, 'access' FROM access UNION ALL SELECT r, stop - n, 2, stop, 'hex' FROM hex UNION ALL SELECT * FROM h),
t AS (SELECT r, rank, start, kind || ':' || start || ':' || stop AS said FROM s)
SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(said, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN t USING (r) GROUP BY r, doc_id"""
