"""Secret scans: fixed patterns, and values in credential contexts that are hard to guess.

Three patterns give the base spans. Besides, every value that a credential context names (`password: ...`, `pwd=...`,
`Authorization: Bearer ...`, `://user:...@host`) is segmented at least guess cost: words of a ranked list, dates,
repeats, keyboard walks and brute-force spans each have a cost in bits, and dynamic programming over the value's ends
finds the cheapest segmentation. A value of at least `least_bits` is a span of kind `guess`; what is cheap to guess is a
placeholder (`changeme`, `qwerty123`), not a secret.

A span is a whole match (kind, start, end; code points, end exclusive), for `guess` the value alone. Base patterns are
matched from left to right without overlaps inside a kind; kinds may overlap. Null and empty texts have no spans, repeated
rows equal ones, empty tables no rows. Long texts and values are scanned whole in linear time. Ties of cost
keep the segment found first, which changes no cost. Rows with a null id are scanned like others; extra columns are
ignored by `scan` and kept by `masked`, which replaces `text` alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches
from .token_counts import MARK, VOCABULARY, Vocabulary

#: The base patterns of the contract and the least length of what each must match (assign: its second group).
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "guess")

_KEY = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|signing)[_-]?key|credentials?|auth(?:orization)?"
_SEPARATOR = r"[A-Za-z0-9_]{0,16}[\"']?[\x20\t]*(?:=>|:=|[:=>])"
CONTEXT = re.compile(
    rf"(?i:{_KEY}){_SEPARATOR}[\x20\t]*(?:(?i:bearer|basic|token)[\x20\t]+)?"
    r"(?:\"([^\"\n]+)\"|'([^'\n]+)'|[\"']?([^\s\"'<>,;(){}\[\]]+))",
    re.ASCII,
)
USERINFO = re.compile(r"://[^\s/:@\"'<>]*:([^\s/@\"'<>]+)@", re.ASCII)
#: Texts without a match of this have no span at all; Arrow looks for it in a whole batch.
_ANY = rf"(?i:{_KEY}){_SEPARATOR}|://[^\s/:@\"'<>]*:[^\s/@\"'<>]+@|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}"

LEAST_VALUE = 6
#: Ten thousand million guesses.
LEAST_BITS = math.log2(1e10)
#: Passwords and placeholders that everyone tries first, before the ranked words.
COMMON = tuple(
    """
    password passwd pass secret changeme change admin administrator root user username guest test testing example sample
    default login letmein welcome master access token none null true false your mypassword dummy foo bar placeholder
    dragon monkey football baseball sunshine princess shadow iloveyou superman batman hunter hello freedom whatever
    """.split()
)
#: What stands for a letter.
LEET = str.maketrans({"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t"})
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Rows of the keyboard, each half a key to the right of the one above, plain and shifted; and the alphabet.
ROWS = (("1234567890-=", "!@#$%^&*()_+"), ("qwertyuiop[]", "QWERTYUIOP{}"), ("asdfghjkl;'", "ASDFGHJKL:\""), ("zxcvbnm,./", "ZXCVBNM<>?"))
ALPHABET = "abcdefghijklmnopqrstuvwxyz"

KIND_BITS = math.log2(5)
LEAST_WORD, MOST_PERIOD, LEAST_WALK = 3, 16, 3
DATE_BITS, YEAR_BITS = math.log2(365.25 * 200), math.log2(200)
_Y, _M, _D, _S = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"([-/._ ]?)"
DATES = tuple(re.compile(a + _S + b + r"\1" + c, re.ASCII) for a, b, c in ((_Y, _M, _D), (_D, _M, _Y), (_M, _D, _Y), (r"\d\d", _M, _D), (_D, _M, r"\d\d"), (_M, _D, r"\d\d")))
YEAR = re.compile(_Y, re.ASCII)


class Segment(NamedTuple):
    kind: str
    start: int
    end: int
    bits: float


def char_bits(c: str) -> float:
    """Brute-force cost of one character: the size of its class."""
    if c.isascii():
        return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return math.log2(4096)


def _places() -> dict[str, list[tuple[float, int, bool]]]:
    """Place of each key (x, y, shifted); the alphabet is a row far away from the others."""
    out: dict[str, list[tuple[float, int, bool]]] = {}
    for y, rows in enumerate(ROWS):
        for shifted, row in enumerate(rows):
            for x, c in enumerate(row):
                out.setdefault(c, []).append((x + y / 2, y, bool(shifted)))
    for x, c in enumerate(ALPHABET):
        out.setdefault(c, []).append((x, 9, False))
        out.setdefault(c.upper(), []).append((x, 9, True))
    return out


PLACES = _places()


def step(a: str, b: str, board: int) -> tuple[float, int] | None:
    """Direction from key a to its neighbour b on the keyboard (0) or in the alphabet (1); None if they aren't neighbours."""
    for x, y, _ in PLACES.get(a, ()):
        for u, v, _ in PLACES.get(b, ()):
            if (y == 9) == (v == 9) == bool(board) and a != b and abs(u - x) <= 1 and abs(v - y) <= 1 and (y != v or abs(u - x) == 1):
                return u - x, v - y
    return None


class GuessCost:
    """Least number of bits, over all segmentations of a value, to guess it."""

    def __init__(self, words: Sequence[str]):
        self.rank: dict[str, int] = {}
        for w in words:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)

    def words(self, s: str) -> Iterator[Segment]:
        """Ranked words in any case, also with signs or digits for letters: the rank, the choice of capitals, a bit for each sign."""
        lower = s.translate(LOWER)
        plain = lower.translate(LEET)
        for i in range(len(s)):
            for j in range(i + LEAST_WORD, min(len(s), i + self.longest) + 1):
                best = math.inf
                for form in {lower[i:j], plain[i:j]}:
                    rank = self.rank.get(form)
                    if rank:
                        signs = sum(a != b for a, b in zip(form, lower[i:j], strict=True))
                        best = min(best, math.log2(rank) + signs)
                if best < math.inf:
                    up = sum("A" <= c <= "Z" for c in s[i:j])
                    simple = up == j - i or (up == 1 and "A" <= s[i] <= "Z")
                    case = 0.0 if not up else 1.0 if simple else 1 + math.log2(math.comb(j - i, up))
                    yield Segment("word", i, j, best + case)

    def dates(self, s: str) -> Iterator[Segment]:
        for i, c in enumerate(s):
            if "0" <= c <= "9":
                for pattern in DATES:
                    m = pattern.match(s, i)
                    if m:
                        yield Segment("date", i, m.end(), DATE_BITS + (2 if m[1] else 0))
                m = YEAR.match(s, i)
                if m:
                    yield Segment("date", i, m.end(), YEAR_BITS)

    def repeats(self, s: str) -> Iterator[Segment]:
        """Blocks of up to MOST_PERIOD characters that repeat as often as they can: the block's own cost and the count."""
        for p in range(1, min(MOST_PERIOD, len(s) // 2) + 1):
            j = p
            while j < len(s):
                if s[j] != s[j - p]:
                    j += 1
                    continue
                begin = j - p
                while j < len(s) and s[j] == s[j - p]:
                    j += 1
                times = (j - begin) // p
                if times >= (3 if p == 1 else 2):
                    for i in range(begin, j - times * p + 1):
                        yield Segment("repeat", i, i + times * p, self.cost(s[i : i + p], repeats=False) + math.log2(times))

    def walks(self, s: str) -> Iterator[Segment]:
        """Longest runs of neighbouring keys: the first key, the turns, the length and a bit for shifted keys."""
        for board, keys in ((0, 47), (1, 26)):
            i = 0
            while i < len(s):
                j, turns, last = i + 1, 0, None
                while j < len(s):
                    way = step(s[j - 1], s[j], board)
                    if way is None:
                        break
                    turns += way != last
                    last = way
                    j += 1
                if j - i >= LEAST_WALK:
                    shifted = any(up and (y == 9) == bool(board) for c in s[i:j] for _, y, up in PLACES[c])
                    yield Segment("walk", i, j, math.log2(keys) + turns * math.log2(6) + math.log2(j - i) + shifted)
                i = max(j - 1, i + 1)

    def matches(self, s: str, repeats: bool = True) -> Iterator[Segment]:
        yield from self.words(s)
        yield from self.dates(s)
        yield from self.walks(s)
        if repeats:
            yield from self.repeats(s)

    def solve(self, s: str, repeats: bool = True) -> tuple[float, list[Segment]]:
        """Least cost of s and its segments. A segment costs its own bits and KIND_BITS to say its kind."""
        ends: list[list[Segment]] = [[] for _ in range(len(s) + 1)]
        for m in self.matches(s, repeats):
            ends[m.end].append(m)
        best, brute = [0.0], [math.inf]  # least cost of a prefix; of one that ends in a brute-force span
        begun, came = [0], [Segment("", 0, 0, 0.0)]  # where that span begins; the last segment of the best prefix
        for j, c in enumerate(s, 1):
            on, new = brute[-1], best[-1] + KIND_BITS
            brute.append(min(on, new) + char_bits(c))
            begun.append(begun[-1] if on <= new else j - 1)
            top, last = brute[-1], Segment("brute", begun[-1], j, 0.0)
            for m in ends[j]:
                t = best[m.start] + m.bits + KIND_BITS
                if t < top:
                    top, last = t, m
            best.append(top)
            came.append(last)
        out, j = [], len(s)
        while j:
            seg = came[j]
            if seg.kind == "brute":
                seg = seg._replace(bits=brute[j] - best[seg.start] - KIND_BITS)
            out.append(seg)
            j = seg.start
        return best[-1], out[::-1]

    def cost(self, s: str, repeats: bool = True) -> float:
        return self.solve(s, repeats)[0]


def ranked_words(path: str = VOCABULARY) -> list[str]:
    """COMMON, then the whole-word pieces of a public vocabulary in its own order, which is about that of frequency."""
    pieces = (p[len(MARK) :].translate(LOWER) for p in Vocabulary.load(path).pieces if p.startswith(MARK))
    return [*COMMON, *(p for p in pieces if len(p) >= LEAST_WORD and p.isalpha())]


def values(text: str) -> Iterator[tuple[int, int]]:
    """Places of the values that credential contexts name, without sentence ends after bare ones."""
    for m in CONTEXT.finditer(text):
        k = m.lastindex
        end = m.end(k) - (len(m[k]) - len(m[k].rstrip(".:!?")) if k == 3 else 0)
        yield m.start(k), end
    for m in USERINFO.finditer(text):
        yield m.span(1)


def spans(text: str, guess: GuessCost, least_bits: float = LEAST_BITS) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, bits) by start, then kind as listed, then end; bits of `guess` alone."""
    out = [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [("access", *m.span(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", *m.span(), None) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    for a, b in set(values(text)):
        if b - a >= LEAST_VALUE:
            bits = guess.cost(text[a:b])
            if bits >= least_bits:
                out.append(("guess", a, b, bits))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))
SPANS = "array<struct<kind: string, start: long, end: long, bits: double>>"
_solvers: dict[int, GuessCost] = {}


def _in_batches(docs: DataFrame, words: Sequence[str], least_bits: float):
    """A function of a text column that gives the spans of each text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(list(words))

    def find(column: pa.Array) -> list[list[tuple[str, int, int, float | None]]]:
        ranked = shared.value
        key = hash(tuple(ranked))
        if key not in _solvers:  # kept for the worker's next tasks
            _solvers.clear()
            _solvers[key] = GuessCost(ranked)
        out: list[list] = [[] for _ in range(len(column))]
        for i in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(column, _ANY), False)).to_pylist():
            out[i] = spans(column[i].as_py(), _solvers[key], least_bits)
        return out

    return find


def scan(docs: DataFrame, words: Sequence[str] | None = None, least_bits: float = LEAST_BITS, text: str = "text") -> DataFrame:
    """doc_id and the spans of every row's whole text."""
    find = _in_batches(docs, ranked_words() if words is None else words, least_bits)

    def rows(batches):
        for b in batches:
            got = [[dict(zip(("kind", "start", "end", "bits"), s, strict=True)) for s in x] for x in find(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, _SPANS)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(f"`{text}`").cast("string")).mapInArrow(rows, f"doc_id {kind}, spans {SPANS}")


def masked(docs: DataFrame, words: Sequence[str] | None = None, least_bits: float = LEAST_BITS) -> DataFrame:
    """docs with every run of overlapping spans of `text` replaced by its first kind in brackets."""
    find = _in_batches(docs, ranked_words() if words is None else words, least_bits)
    at = docs.columns.index("text")

    def hide(text: str, found: list) -> str:
        out, done = [], 0
        for kind, a, b, _ in found:
            if a >= done:
                out += [text[done:a], f"[{kind}]"]
            done = max(done, b)
        return "".join(out) + text[done:]

    def rows(batches):
        for b in batches:
            texts = [hide(t.as_py(), x) if x else t.as_py() for t, x in zip(b.column(at), find(b.column(at)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, b.column(at).type), *b.columns[at + 1 :]], b.schema.names)

    return map_rows(docs, rows)


def joined(found: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _is(kind: str):
    return lambda x: x["kind"] == kind


def report(docs: DataFrame, words: Sequence[str] | None = None, least_bits: float = LEAST_BITS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans (as text) and most_bits of every row."""
    found = F.col("spans")
    number = [F.size(F.filter(found, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter(found, lambda x: x["kind"] != "guess")
    most = F.array_max(F.transform(found, lambda x: x["bits"]))
    return scan(docs, words, least_bits).select("doc_id", *number, F.sha2(joined(base), 256).alias("base_sha256"), joined(found).alias("spans"), most.alias("most_bits"))
