"""The search language of the list, its filters, and result orders."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import numbered

_TERM = re.compile(r"^(source|tag|cat|topic|risk):(.+)$", re.I)
_SCORE = re.compile(r"^score(>=|<=|>|<)(\d+)$", re.I)


class Query(NamedTuple):
    terms: dict[str, str]
    score: tuple[str, int] | None
    text: str


def parse(query: str) -> Query:
    """`source: tag: cat: topic: risk:` and `score` comparisons; the last of a kind counts, other words are free text."""
    terms, score, words = {}, None, []
    for word in query.split():
        if m := _SCORE.match(word):
            score = m[1], int(m[2])
        elif m := _TERM.match(word):
            terms[m[1].lower()] = m[2].lower()
        else:
            words.append(word)
    return Query(terms, score, " ".join(words))


def condition(q: Query) -> Column:
    """Rows that fulfil all operators of a query. risk:uncertain is any flag."""
    has = lambda c, v: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(v)
    out = F.lit(True)
    for kind, value in q.terms.items():
        if kind == "tag":
            out = out & F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t).contains(value))
        elif kind == "risk":
            flags = F.coalesce("flags", F.array().cast("array<string>"))
            out = out & (F.size(flags) > 0 if value == "uncertain" else F.exists(flags, lambda t: F.lower(t).contains(value)))
        else:
            out = out & has({"source": "source", "cat": "category", "topic": "topic"}[kind], value)
    if q.score:
        op, n = q.score
        s = F.coalesce(F.col("score"), F.lit(0))
        out = out & {">": s > n, ">=": s >= n, "<": s < n, "<=": s <= n}[op]
    return out


def search(rows: DataFrame, query: str) -> DataFrame:
    """Operators, and every free word somewhere in title or source."""
    q = parse(query)
    out = rows.filter(condition(q))
    for word in q.text.lower().split():
        out = out.filter(F.lower(F.concat_ws(" ", "title", "source")).contains(word))
    return out


#: Fields of the fuzzy search, the share of a query that may differ, and its least length.
FUZZY_FIELDS, FUZZY_THRESHOLD, FUZZY_LEAST = ("title", "source", "tags", "summary"), 0.4, 2
#: Characters of a query that one machine word holds.
WORD_BITS = 63


def least_errors(texts: Sequence[str], pattern: str, most: int) -> np.ndarray:
    """For each text the least number of edits, up to `most`, that make one of its substrings the pattern; most + 1 if none does.

    Bit-parallel: bit i of state d says that the first i + 1 characters of the pattern end here with d edits at most.
    One step per character moves the states of all texts that are as long.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-size, kind="stable")
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = (np.cumsum(size) - size)[order]
    masks = np.zeros(max([0, *map(ord, pattern)]) + 2, np.uint64)
    for i, c in enumerate(pattern):
        masks[ord(c)] |= np.uint64(1 << i)
    one, last = np.uint64(1), np.uint64(1 << (len(pattern) - 1))
    state = [np.full(len(texts), (1 << d) - 1, np.uint64) for d in range(most + 1)]
    best = np.full(len(texts), most + 1)
    sizes = -size[order]
    for k in range(int(size.max(initial=0))):
        alive = int(np.searchsorted(sizes, -k, "left"))  # texts longer than k
        mask = masks[np.minimum(points[at[:alive] + k], len(masks) - 1)]
        before = after = None
        for d, s in enumerate(state):
            old = s[:alive].copy()
            now = ((old << one) | one) & mask
            if d:
                now |= before | (before << one) | (after << one) | one
            s[:alive] = now
            before, after = old, now
        for d in range(most, -1, -1):
            hit = (state[d][:alive] & last) != 0
            best[:alive][hit & (best[:alive] > d)] = d
    out = np.empty(len(texts), np.int64)
    out[order] = best
    return out


def fuzzy(rows: DataFrame, query: str, fields: Sequence[str] = FUZZY_FIELDS, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """rows with distance: the least share of the query to edit to find it in one of the fields; at most the threshold.

    A query that differs in k characters, cut into k + 1 pieces, has one of them unchanged: rows without any piece never
    leave the JVM. The others are searched once, all fields joined by more blanks than a match can bridge. Queries
    under two characters find nothing; of queries over 63 characters each piece of up to 63 is searched and the mean counts.
    """
    query = query.lower()
    if len(query) < FUZZY_LEAST:
        return rows.withColumn("distance", F.lit(0.0)).limit(0)
    parts = -(-len(query) // WORD_BITS)
    pieces = [query[len(query) * i // parts : len(query) * (i + 1) // parts] for i in range(parts)]
    errors = [int(threshold * len(p) * (1 if parts == 1 else parts) + 1e-9) for p in pieces]
    errors = [min(e, len(p) - 1) for e, p in zip(errors, pieces, strict=True)]
    gap = "\0" * (max(errors) + 1)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    texts = [F.array_join(c, gap) if kinds[c].startswith("array") else F.col(c) for c in fields if c in kinds]
    whole = F.lower(F.concat_ws(gap, *texts))

    @F.pandas_udf("double")
    def distance(text: pd.Series) -> pd.Series:
        found = sum(least_errors(text.tolist(), p, e) for p, e in zip(pieces, errors, strict=True))
        return pd.Series(found / len(query))

    near = rows.withColumn("_whole", whole)
    if parts == 1:
        n = errors[0] + 1
        cut = [query[len(query) * i // n : len(query) * (i + 1) // n] for i in range(n)]
        held = F.lit(False)
        for c in cut:
            held = held | F.col("_whole").contains(c)
        near = near.filter(held)
    return near.withColumn("distance", distance("_whole")).filter(F.col("distance") <= threshold).drop("_whole")


def list_filter(rows: DataFrame, muted: DataFrame | None = None, read: DataFrame | None = None, saved: DataFrame | None = None, important: bool = False, query: str = "", category: str | None = None, source: str | None = None, tag: str | None = None) -> DataFrame:
    """The list's filters in their order; free text replaces the category, source and tag filters."""
    out = rows
    if muted is not None:
        out = out.join(muted.select("source").distinct(), "source", "left_anti")
    if read is not None:
        out = out.join(read.select("id").distinct(), "id", "left_anti")
    if saved is not None:
        out = out.join(saved.select("id").distinct(), "id", "left_semi")
    if important:
        out = out.filter(F.col("score") >= 7)
    q = parse(query)
    out = out.filter(condition(q))
    if q.text:
        return search(out, q.text)
    for column, value in (("category", category), ("source", source)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out.filter(F.array_contains("tags", tag)) if tag is not None else out


def semantic_order(rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """rows with position: those in ranked (id, rank) first in its order, the rest as they were (ord)."""
    return numbered(rows.join(ranked, "id", "left"), [F.col("rank").asc_nulls_last(), F.col("ord").asc()]).drop("rank")


def hide_duplicates(rows: DataFrame) -> DataFrame:
    """Without duplicates whose kept copy is in the same result."""
    kept = rows.select(F.col("id").alias("_kept"))
    return rows.join(kept, F.col("duplicate_of") == F.col("_kept"), "left_anti")
