"""Questions bound to a table: what is measured, by what, of which values, when, in which order, how many."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import MONTHS
from .nlq import _NUMBERS, RATIOS, _named

#: Most words of a value that a question may name, and most groupings.
LONGEST, GROUPINGS = 6, 2
DOWN, UP = r"\b(top|best|highest|most|largest)\b", r"\b(bottom|worst|lowest|least|smallest)\b"
_TIME = r"(?:(" + "|".join(MONTHS) + r")[a-z]* )?((?:19|20)\d\d)"


@dataclass(frozen=True)
class Question:
    """What a question says: measures, groupings, wanted and unwanted values by column, first and last month (last excluded), order and number of rows."""

    measures: tuple[str, ...]
    groups: tuple[str, ...] = ()
    wanted: dict[str, tuple[str, ...]] = field(default_factory=dict)
    unwanted: dict[str, tuple[str, ...]] = field(default_factory=dict)
    since: str | None = None
    until: str | None = None
    rising: bool | None = None
    limit: int | None = None


def plain(c: Column) -> Column:
    """A value as a question would say it: lower case words with single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def _phrases(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + n]) for n in range(1, LONGEST + 1) for i in range(len(words) - n + 1)})


def _months(said: str) -> tuple[str | None, str | None]:
    """First month and the month after the last of: between A and B, from A to B, since A, after A, before A, until A, in A."""

    def first(m: tuple[str, str]) -> tuple[int, int]:
        return int(m[1]), MONTHS.index(m[0]) + 1 if m[0] else 1

    def after(m: tuple[str, str]) -> tuple[int, int]:
        y, k = first(m)
        return (y + 1, 1) if not m[0] or k == 12 else (y, k + 1)

    day = lambda x: f"{x[0]:04d}-{x[1]:02d}-01"
    if m := re.search(rf"\b(?:between|from) {_TIME} (?:and|to|until) {_TIME}\b", said):
        return day(first((m[1], m[2]))), day(after((m[3], m[4])))
    since = re.search(rf"\bsince {_TIME}\b", said)
    later = re.search(rf"\bafter {_TIME}\b", said)
    before = re.search(rf"\bbefore {_TIME}\b", said)
    until = re.search(rf"\b(?:until|through) {_TIME}\b", said)
    inside = re.search(rf"\b(?:in|during|for) {_TIME}\b", said)
    lo = day(first(since.groups())) if since else day(after(later.groups())) if later else day(first(inside.groups())) if inside else None
    hi = day(first(before.groups())) if before else day(after(until.groups())) if until else day(after(inside.groups())) if inside else None
    return lo, hi


def understood(table: DataFrame, asked: str) -> Question:
    """The meaning of a question about a table, whose columns, types and values are the vocabulary.

    Values are looked up the other way round: the table is searched for the few phrases of the question, so what comes to
    the driver is bounded by the question. Of phrases that overlap the longest counts; behind not, without, except or
    excluding a value is unwanted. Questions without anything to measure are refused.
    """
    kinds = dict(table.dtypes)
    text = [c for c, t in kinds.items() if t == "string"]
    times = [c for c, t in kinds.items() if t in ("date", "timestamp")]
    numbers = [c for c in kinds if c not in text and c not in times]
    said = " ".join(re.sub(r"[^a-z0-9]+", " ", asked.lower()).split())
    ratio = next((r for r in RATIOS if re.search(rf"\b{r}\b", said)), None)
    measures = (ratio.replace(" ", "_"),) if ratio else tuple(_named(said, numbers))
    if not measures:
        raise ValueError(f"nothing to measure in: {asked}")
    every = table.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in text))).alias("x")).select("x.*") if text else None
    found = every.where(plain(F.col("v")).isin(_phrases(said.split()))).distinct().withColumn("p", plain(F.col("v"))).collect() if text else []
    wanted, unwanted, rest = {}, {}, said
    for r in sorted(found, key=lambda r: (-len(r.p), r.c, r.v)):
        if m := re.search(rf"\b(?:(not|without|except|excluding) (?:for |in |from )?)?{r.p}\b", rest):
            (unwanted if m[1] else wanted).setdefault(r.c, []).append(r.v)
            rest = rest[: m.start()] + " ~ " + rest[m.end() :]
    # a name of several words counts before a column that shares one of them
    whole = {c: m.start() for c in text + times if "_" in c and (m := re.search(rf"\b{c.replace('_', ' ')}s?\b", rest))}
    short = rest
    for c in whole:
        short = re.sub(rf"\b{c.replace('_', ' ')}s?\b", lambda m: " " * len(m[0]), short)
    groups = sorted([*whole, *_named(short, [c for c in text + times if c not in whole])], key=lambda c: whole.get(c, rest.find(c.split("_")[0])))
    if times and not set(times) & set(groups) and re.search(r"\b(trend|trends|over time|monthly|months?)\b", rest):
        groups = [*groups, times[0]]
    if not groups and ratio and not (wanted or unwanted):
        groups = text[:1]
    since, until = _months(said)
    down, up = re.search(DOWN, rest), re.search(UP, rest)
    n = re.search(rf"\b(\d{{1,3}}|{'|'.join(_NUMBERS)})\b", rest)
    limit = (_NUMBERS.get(n[1]) or int(n[1]) if n else 5) if down or up else None
    fixed = lambda d: {c: tuple(sorted(v)) for c, v in d.items()}
    return Question(measures, tuple(groups[:GROUPINGS]), fixed(wanted), fixed(unwanted), since, until, bool(up) if down or up else None, limit)


def answered(table: DataFrame, q: Question) -> DataFrame:
    """The rows that a question asks for: one for each combination of its groupings, ratios as ratios of sums."""
    kinds = dict(table.dtypes)
    times = [c for c, t in kinds.items() if t in ("date", "timestamp")]
    tests = [F.col(c).isin(*v) for c, v in q.wanted.items()] + [~F.col(c).isin(*v) for c, v in q.unwanted.items()]
    tests += [F.col(times[0]) >= F.to_date(F.lit(q.since))] if q.since and times else []
    tests += [F.col(times[0]) < F.to_date(F.lit(q.until))] if q.until and times else []
    rows = table.where(reduce(lambda a, b: a & b, tests)) if tests else table
    ratios = {r.replace(" ", "_"): ab for r, ab in RATIOS.items()}
    total = lambda c: F.sum(c).cast("double") if "decimal" in kinds[c] or kinds[c] == "double" else F.sum(c)
    shown = [(F.try_divide(total(ratios[m][0]).cast("double"), total(ratios[m][1]).cast("double")) if m in ratios else total(m)).alias(m) for m in q.measures]
    out = rows.groupBy(*q.groups).agg(*shown)
    first = F.col(q.measures[0])
    timed = [c for c in q.groups if c in times]
    order = timed if q.rising is None and timed else [first.asc_nulls_last() if q.rising else first.desc_nulls_last(), *q.groups]
    out = out.orderBy(*order) if q.groups else out
    return out.limit(q.limit) if q.limit is not None and q.groups else out


def ask(table: DataFrame, question: str) -> DataFrame:
    """understood() and answered()."""
    return answered(table, understood(table, question))
