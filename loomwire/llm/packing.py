"""Token ids of whole texts, packed into rows of one length.

Texts are encoded by a public byte-level BPE, each followed by an end token, and split losslessly into
pieces of at most `length` ids. Pieces are packed by best-fit decreasing: the longest first, each into
the open row with the least room that is enough, found in a segment tree over capacities. Every task
packs windows of about `window` ids as it reads, so memory is bounded and nothing is shuffled.

A row has its ids (little-endian, two bytes, or four for larger vocabularies, filled up with the end token), the
cumulative lengths of its segments, where positions begin anew, and for each segment the document and
its offset in the document's ids: enough to restore every document (see `unpack`).

Null texts count as empty: one end token. Null ids stay null. Repeated rows are packed each; of pieces of one length
the one read first goes first; very long texts become many pieces; an empty table gives no rows; extra columns are ignored. Reruns over the same input files give the same rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches

#: Only the driver opens it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256  # fixed value: the id that this vocabulary leaves free for the end of a text
#: Fixed value: the vocabulary's pattern of words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern's \s has it.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space and the word after it: no token of PATTERN crosses from one such unit to the next.
_UNIT = re.compile(f"[{_S}]*[^{_S}]+|[{_S}]+")
LENGTH, WINDOW, CACHE = 2048, 4_000_000, 300_000
SCHEMA = "pack_id long, ids binary, cu_seqlens array<int>, reset_at array<int>, doc_ids array<{}>, doc_offsets array<long>"
_encoders: dict[int, Encoder] = {}


class Encoder(dict):
    """Bytes of the ids of a unit, remembered."""

    def __init__(self, ranks: bytes, end: int = END):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.kind = np.dtype("<u2" if max(end, len(table)) < 65536 else "<u4")
        self.end = np.array([end], self.kind).tobytes()

    def __missing__(self, unit: str) -> bytes:
        ids = np.array(self.bpe.encode_ordinary(unit), self.kind).tobytes()
        if len(unit) <= 48:
            if len(self) >= CACHE:
                self.clear()
            self[unit] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of the text and its end."""
        return b"".join(map(self.__getitem__, _UNIT.findall(text or ""))) + self.end


class Capacities:
    """Segment tree over 0..n: which capacities some open row has; finds the least one that is enough."""

    def __init__(self, n: int):
        self.half = 1 << n.bit_length()
        self.count = [0] * (2 * self.half)
        self.rows: list[list[int]] = [[] for _ in range(n + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = self.half + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A row of the smallest capacity that is at least `least`, removed from the tree."""
        count, i = self.count, self.half + least
        while not count[i]:
            while i & 1:  # a right child: nothing further right below its parent
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.half:
            i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.half
        row = self.rows[capacity].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indices into sizes; every size is from 1 to length."""
    open_, rows = Capacities(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = open_.take(sizes[i])
        if found is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            open_.add(room - sizes[i], row)
    return rows


def _rows(docs: list[tuple[object, bytes]], length: int, kind: np.dtype, end: bytes) -> Iterator[tuple]:
    step = length * kind.itemsize
    segments = [(doc, at // kind.itemsize, ids[at : at + step]) for doc, ids in docs for at in range(0, len(ids), step)]
    for row in best_fit_decreasing([len(s[2]) // kind.itemsize for s in segments], length):
        own = [segments[i] for i in row]
        cu = np.concatenate([[0], np.cumsum([len(s[2]) for s in own])]) // kind.itemsize
        ids = b"".join(s[2] for s in own)
        yield ids + end * (length - cu[-1]), cu.tolist(), cu[:-1].tolist() + ([int(cu[-1])] if cu[-1] < length else []), [s[0] for s in own], [s[1] for s in own]


def pack(docs: DataFrame, ranks: str = RANKS, end: int = END, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        data = shared.value
        key = hash((data, end))
        if key not in _encoders:  # kept for the worker's next tasks
            _encoders.clear()
            _encoders[key] = Encoder(data, end)
        encoder = _encoders[key]
        number, kept, held = TaskContext.get().partitionId() << 32, [], 0
        id_type = None

        def packed():
            nonlocal number
            rows = list(_rows(kept, length, encoder.kind, encoder.end))
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                ids, cu, resets, owners, offsets = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(number, number + len(part)), pa.int64()), pa.array(ids, pa.binary()), pa.array(cu, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())), pa.array(owners, pa.list_(id_type)), pa.array(offsets, pa.list_(pa.int64()))],
                    ["pack_id", "ids", "cu_seqlens", "reset_at", "doc_ids", "doc_offsets"],
                )
                number += len(part)
            kept.clear()

        for b in batches:
            id_type = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoder.encode(text.as_py())
                kept.append((doc, ids))
                held += len(ids) // encoder.kind.itemsize
                if held >= window:
                    yield from packed()
                    held = 0
        yield from packed()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(kind.simpleString()))


def position_ids(reset_at: list[int], length: int = LENGTH) -> np.ndarray:
    """Positions of a row, beginning anew at each of reset_at."""
    at = np.zeros(length, int)
    begin = np.asarray(reset_at, int)
    at[begin[1:]] = np.diff(begin)
    return np.arange(length) - np.cumsum(at)


def unpack(rows: list, end: int = END, width: str = "<u2") -> dict:
    """Ids of each document, without the end token: the inverse of pack for ids that are unique."""
    parts: dict = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], width)
        for doc, off, a, b in zip(r["doc_ids"], r["doc_offsets"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            parts.setdefault(doc, []).append((off, ids[a:b]))
    out = {}
    for doc, own in parts.items():
        whole = np.concatenate([x for _, x in sorted(own, key=lambda p: p[0])])
        if whole[-1] != end:
            raise ValueError(f"document {doc} doesn't end with the end token")
        out[doc] = whole[:-1].tolist()
    return out
