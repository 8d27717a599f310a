"""URL filters: glob rules simulated together by one bit-parallel automaton.

A rule is a glob over the canonical form `.host/path` of a URL: `*` stands for any run of characters
without a slash, `**` for any run. All rules share one Shift-And automaton whose states are the bits
of as many 64-bit words as they need; one step per character moves every rule of every URL of a batch.

Nulls and URLs without `://` have an empty host and path, fit no rule and get the default verdict.
Repeated rows give repeated rows, an empty table none. Very long URLs only cost their length. Of rules of one
length that fit a URL the first listed wins. Extra columns stay; those named as the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        """The rule's host and all its subdomains, and all paths that begin with its own."""
        return [f"*.{self.host}{self.path}**"] if self.path else [f"*.{self.host}", f"*.{self.host}/**"]


#: The rules of the contract; the longest that fits a URL wins.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: For URLs that no rule fits: globs over `.host/path` of what isn't worth reading. Hosts first (all their paths), then paths.
BLOCKED_HOSTS = tuple("*spam* *casino* *poker* *gambl* *betting* *porn* *viagra* *adserver* *.ads.* *.adserv.* *tracker.* *.doubleclick.net *.onion".split())
BLOCKED_PATHS = tuple(
    """
    *.*/**/wp-login.php** *.*/wp-login.php** *.*/wp-admin/** *.*/cgi-bin/** *.*/login *.*/login/** *.*/signin** *.*/logout** *.*/cart/** *.*/checkout/**
    *.*/**.exe *.*/**.zip *.*/**.gz *.*/**.iso *.*/**.mp3 *.*/**.mp4 *.*/**.avi *.*/**.jpg *.*/**.jpeg *.*/**.png *.*/**.gif *.*/**.css *.*/**.js
    """.split()
)


def default_globs(hosts: Sequence[str], paths: Sequence[str]) -> list[str]:
    return [g for h in hosts for g in ((h if h.startswith("*") else f".{h}"), (h if h.startswith("*") else f".{h}") + "/**")] + list(paths)


class ShiftAnd:
    """Extended Shift-And over bytes; bit j of a pattern is set after its first j literals have been read."""

    def __init__(self, globs: Sequence[str]):
        states, step, loop, self.final = 0, [], [], []
        begin = []
        for glob in globs:
            begin.append(states)
            tokens = self._tokens(glob)
            state = states
            for kind, byte in tokens:
                if kind == "byte":
                    state += 1
                    step.append((byte, state))
                else:
                    loop.append((kind, state))
            self.final.append(state)
            states = state + 1
        self.words = max(1, -(-states // 64))
        self.step, self.loop = (np.zeros((256, self.words), np.uint64) for _ in range(2))
        self.begin = np.zeros(self.words, np.uint64)
        for byte, s in step:
            self.step[byte, s // 64] |= np.uint64(1 << s % 64)
        for kind, s in loop:
            bytes_ = [c for c in range(256) if kind == "any" or c != 0x2F]
            self.loop[bytes_, s // 64] |= np.uint64(1 << s % 64)
        for s in begin:
            self.begin[s // 64] |= np.uint64(1 << s % 64)

    @staticmethod
    def _tokens(glob: str) -> list[tuple[str, int]]:
        out, i = [], 0
        while i < len(glob):
            if glob[i] == "*":
                wide = glob[i : i + 2] == "**"
                out.append(("any" if wide else "segment", 0))
                i += 2 if wide else 1
            else:
                out += [("byte", b) for b in glob[i].encode()]
                i += 1
        return out

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row of booleans, one for each glob, for each text."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate([[0], np.cumsum(size)[:-1]])[order] if len(texts) else size
        state = np.repeat(self.begin[None], len(texts), 0)
        alive = len(texts)
        for k in range(int(size.max(initial=0))):
            alive = int(np.searchsorted(-size[order], -k, "left"))  # texts longer than k
            c = data[at[:alive] + k]
            now = state[:alive]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:alive] = (moved & self.step[c]) | (now & self.loop[c])
        out = np.empty((len(texts), len(self.final)), bool)
        for p, s in enumerate(self.final):
            out[order, p] = (state[:, s // 64] >> np.uint64(s % 64)) & np.uint64(1)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(df: DataFrame, url: str = "url", rules: Sequence[Rule] = RULES, blocked_hosts: Sequence[str] = BLOCKED_HOSTS, blocked_paths: Sequence[str] = BLOCKED_PATHS) -> DataFrame:
    """Adds host, path, rule and verdict to df; columns of df with these names are replaced. Of rules of one length the first listed wins."""
    names = [r.name for r in rules]
    order = sorted(range(len(rules)), key=lambda i: (-len(names[i]), i))
    globs = [(i, g) for i in order for g in rules[i].globs()]
    own = [(-2, g) for g in default_globs(blocked_hosts, blocked_paths)]
    built: list[ShiftAnd] = []

    @F.pandas_udf("int")
    def verdict(canonical: pd.Series) -> pd.Series:
        """Index of the winning rule; -2 if only the default rules block, else -1."""
        if not built:
            built.append(ShiftAnd([g for _, g in globs + own]))
        hit = built[0].match([x.encode() for x in canonical])
        value = np.array([i for i, _ in globs + own] + [-1])
        first = np.where(hit.any(1), hit.argmax(1), len(value) - 1) if hit.shape[1] else np.full(len(canonical), -1)
        return pd.Series(value[first].astype("int32"))

    host, path = host_and_path(F.col(url))
    hit = "_hit"
    while {hit, "host_" + hit, "path_" + hit} & {c.lower() for c in df.columns}:
        hit += "_"
    judged = df.select("*", host.alias("host_" + hit), path.alias("path_" + hit)).withColumn(hit, verdict(F.concat(F.lit("."), "host_" + hit, "path_" + hit)))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col(hit)) if values else F.lit(None).cast("string")
    rule = F.when(F.col(hit) >= 0, pick(names))
    said = F.when(F.col(hit) >= 0, pick([r.verdict for r in rules])).when(F.col(hit) == -2, "block").otherwise("allow")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    return judged.select(*keep, F.col("host_" + hit).alias("host"), F.col("path_" + hit).alias("path"), rule.alias("rule"), said.alias("verdict"))


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob."""
    return "^" + "".join({"**": ".*", "*": "[^/]*"}.get(part, re.escape(part)) for part in re.split(r"(\*\*|\*)", glob)) + "$"


_DEFAULT = " OR ".join(f"regexp_matches('.' || host || path, '{glob_pattern(g)}', 's')" for g in default_globs(BLOCKED_HOSTS, BLOCKED_PATHS))
ORACLE_SQL = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN coalesce(position('://' IN url), 0) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM named
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN {_DEFAULT} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
