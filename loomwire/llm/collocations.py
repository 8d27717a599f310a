"""Phrases whose words keep company, counted by Suffix-sigma.

Texts are lower-cased (A-Z) and cut at punctuation and line ends into pieces, pieces at blanks into words. Every word begins a
suffix of its piece, cut off after `most` words. Tasks add up equal suffixes of some megabytes of text and deal
them, by language and first word, into buckets as blocks of numbers with a dictionary. A bucket sorts its suffixes
reverse-lexicographically, so that suffixes with a common beginning are neighbours and the longer come first, and one stack
counts all prefixes: a prefix of d words is open as long as each suffix shares d words with the one before, and its
count is the sum over that run. The stack's levels are worked off for a whole bucket at once.

First words that fill more than half a bucket (exact counts of a first pass say which) are dealt by their whole suffix;
what their prefixes have in each bucket is added up by Spark. A bucket holds about `BUCKET_WORDS` suffixes at any size
of the corpus; partitions work off their buckets one by one.

Afterwards each candidate meets the counts of its parts. With a the candidate's count, l and r those of the parts before and
after a cut, the score is floor(1000000 * a * a / (l * r)) in exact decimals (a below 10**16); the cut with the lowest
counts, of equal ones the first. Candidates inside a longer one that is at least half as frequent go.

Null languages are the language `und`; null and empty texts have no words, nor has an empty table. Of equal scores the more
frequent, then the smaller phrase (UTF-8 bytes) comes first; phrases differ, so there are no other ties. Repeated rows count each. Very
long texts are one text; words may be of any length. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import LOWER, mix, texts_of
from .common import bounded, forget, small_batches, written

LEAST, MOST, TOP, INSIDE = 10, 3, 2000, 50
NO_LANGUAGE = "und"
#: Bytes of text whose suffixes a task adds up before it deals them out, and suffixes of a bucket.
FLUSH_BYTES, BUCKET_WORDS = 3 << 20, 1_000_000
#: Bytes of an Arrow batch; a partition of blocks comes in many of them.
BATCH_BYTES = 8 << 20
#: Lists that one task merges when the best of a language are found.
FAN_IN = 32
#: The signs that end a piece, and the blanks between words.
CLASS = np.zeros(256, np.uint8)
CLASS[[0x20, 0x09]] = 1
CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
END = 0x0A


class Words(NamedTuple):
    """The words of some texts: a code for each, the codes' words, the language of each as a code, and its piece."""

    codes: np.ndarray
    words: pa.Array
    lang: np.ndarray
    langs: pa.Array
    piece: np.ndarray


def words_of(texts: pa.Array, langs: pa.Array) -> Words:
    """All words of the texts in order. Equal strings have equal codes."""
    sizes, pieces, rows, data = [], [], [], []
    piece = 0
    for first, ends, b in texts_of(texts):
        kind = CLASS[b]
        kind[ends - 1] = 2
        word = kind == 0
        begin = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]))
        stop = np.flatnonzero(word & np.concatenate([~word[1:], [True]])) + 1
        cut = np.cumsum(kind == 2)
        sizes.append(stop - begin)
        pieces.append((cut[begin] + piece).astype(np.int32))
        rows.append((np.searchsorted(ends, begin, "right") + first).astype(np.int32))
        data.append(LOWER[b[word]])
        piece += int(cut[-1]) + 1
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    size = join(sizes, np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    flat = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(join(data, np.uint8)))
    coded = flat.dictionary_encode()
    of_lang = pc.fill_null(langs, NO_LANGUAGE).dictionary_encode()
    lang = of_lang.indices.to_numpy()[join(rows, np.int32)]
    return Words(coded.indices.to_numpy(), coded.dictionary, lang, of_lang.dictionary, join(pieces, np.int32))


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Words of (lang, text) batches, about FLUSH_BYTES of text at a time."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(1).nbytes
        if size >= FLUSH_BYTES:
            yield _words(held)
            held, size = [], 0
    if held:
        yield _words(held)


def _words(held: list[pa.RecordBatch]) -> Words:
    lang, text = (pa.chunked_array([b.column(i).cast(pa.large_string()) for b in held]).combine_chunks() for i in (0, 1))
    return words_of(text, lang)


def packed(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row of the columns, in the rows' lexicographic order. Columns hold numbers from 0."""
    key, most = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        n = int(c.max(initial=0)) + 1
        if most * n >= 1 << 62:
            there, key = np.unique(key, return_inverse=True)
            most = len(there)
        key, most = key * n + c, most * n
    return key


def hashes(strings: pa.Array) -> np.ndarray:
    """64 bits of each string, the same in every process."""
    return pd.util.hash_array(np.array(strings.to_pylist(), object)) if len(strings) else np.zeros(0, np.uint64)


def totals(docs: DataFrame) -> DataFrame:
    """lang, word, f: exact counts of single words."""

    def count(batches):
        for w in _flushes(batches):
            _, at, n = np.unique(packed([w.lang, w.codes]), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([w.langs.take(pa.array(w.lang[at])).cast(pa.string()), w.words.take(pa.array(w.codes[at])).cast(pa.string()), pa.array(n)], ["lang", "word", "f"])

    return docs.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def suffixes(w: Words, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct suffixes, as columns of a language and `most` words (code + 1, 0 for none), and how often each occurs."""
    columns = [w.lang, w.codes + 1]
    for k in range(1, most):
        on = np.zeros(len(w.codes), np.int32)
        same = w.piece[k:] == w.piece[:-k] if len(w.piece) > k else np.zeros(0, bool)
        on[: len(same)] = np.where(same, w.codes[k:] + 1, 0)
        columns.append(on)
    _, at, n = np.unique(packed(columns), return_index=True, return_counts=True)
    return [c[at] for c in columns], n


def _blocks(docs: DataFrame, hot: list[tuple[str, str]], buckets: int, most: int) -> DataFrame:
    """bucket, langs, words, codes (a language and `most` words for each suffix, column by column) and n."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def deal(batches):
        spread = pd.MultiIndex.from_tuples(shared.value) if shared.value else None
        for w in _flushes(batches):
            if not len(w.codes):
                continue
            columns, n = suffixes(w, most)
            by_word = np.concatenate([[np.uint64(0)], mix(hashes(w.words))])
            first = mix(by_word[columns[1]] + hashes(w.langs)[columns[0]])
            whole = first
            for c in columns[2:]:
                whole = mix(whole * np.uint64(31) + by_word[c])
            if spread is not None:
                found = np.zeros((len(w.langs), len(w.words)), bool)
                i, j = pd.Index(w.langs.to_pylist()).get_indexer(spread.get_level_values(0)), pd.Index(w.words.to_pylist()).get_indexer(spread.get_level_values(1))
                there = (i >= 0) & (j >= 0)
                found[i[there], j[there]] = True
                first = np.where(found[columns[0], columns[1] - 1], whole, first)
            bucket = (first % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            columns, n, bucket = [c[order] for c in columns], n[order], bucket[order]
            ends = np.flatnonzero(np.concatenate([bucket[1:] != bucket[:-1], [True]])) + 1
            used, codes, a = [], [], 0
            for b in ends:
                part = np.concatenate([c[a:b] for c in columns[1:]])
                words, local = np.unique(part, return_inverse=True)
                if words[0] != 0:
                    words, local = np.concatenate([[0], words]), local + 1
                used.append(words[1:] - 1)
                codes.append(np.concatenate([columns[0][a:b], local]).astype(np.int32))
                a = b
            lists = lambda x, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(i) for i in x])]).astype(np.int32)), values)
            n_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(n.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[ends - 1]),
                    pa.array([w.langs.to_pylist()] * len(ends), pa.list_(pa.string())),
                    lists(used, w.words.take(pa.array(np.concatenate(used))).cast(pa.string())),
                    lists(codes, pa.array(np.concatenate(codes))),
                    n_lists,
                ],
                ["bucket", "langs", "words", "codes", "n"],
            )

    return docs.mapInArrow(deal, "bucket long, langs array<string>, words array<string>, codes array<int>, n array<int>")


class Bucket:
    """All suffixes of one bucket, from its blocks."""

    def __init__(self, most: int):
        self.most = most
        self.langs, self.words, self.columns, self.n = [], [], [[] for _ in range(most + 1)], []
        self.n_langs = self.n_words = 0

    def add(self, langs: pa.Array, words: pa.Array, codes: np.ndarray, n: np.ndarray) -> None:
        rows = codes.reshape(self.most + 1, len(n))
        self.columns[0].append(rows[0] + self.n_langs)
        for k in range(1, self.most + 1):
            self.columns[k].append(np.where(rows[k] > 0, rows[k] + self.n_words, 0))
        self.langs.append(langs)
        self.words.append(words)
        self.n.append(n)
        self.n_langs += len(langs)
        self.n_words += len(words)

    @staticmethod
    def _ranked(arrays: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
        """The distinct strings in byte order, and the place of each given one among them."""
        coded = pa.chunked_array(arrays).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]

    def prefixes(self) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, int]]:
        """For each number of words: languages, phrases and counts of all prefixes of that many words."""
        langs, lang_rank = self._ranked(self.langs)
        words, word_rank = self._ranked(self.words)
        rank = np.concatenate([np.zeros(1, np.int32), word_rank + 1])
        columns = [lang_rank[np.concatenate(self.columns[0])], *(rank[np.concatenate(c)] for c in self.columns[1:])]
        order = np.argsort(packed(columns))[::-1]  # reverse-lexicographic: longer suffixes before their beginnings
        columns, n = [c[order] for c in columns], np.concatenate(self.n)[order].astype(np.int64)
        # how many levels of the stack stay open from one suffix to the next
        same, shared = np.ones(len(n) - 1, bool), np.zeros(len(n) - 1, np.int8)
        for c in columns:
            same = same & (c[1:] == c[:-1])
            shared += same
        for d in range(1, self.most + 1):
            opened = np.concatenate([[0], np.flatnonzero(shared < d + 1) + 1])
            count = np.add.reduceat(n, opened)
            full = columns[d][opened] > 0
            opened, count = opened[full], count[full]
            parts = [words.take(pa.array(columns[k][opened] - 1)) for k in range(1, d + 1)]
            yield langs.take(pa.array(columns[0][opened])), pc.binary_join_element_wise(*parts, pa.scalar(" ", parts[0].type)) if d > 1 else parts[0], count, d


def counts(docs: DataFrame, hot: list[tuple[str, str]], buckets: int, least: int, most: int) -> DataFrame:
    """lang, phrase, words, f of all phrases of up to `most` words that occur `least` times, by Suffix-sigma."""
    shared = docs.sparkSession.sparkContext.broadcast(set(hot))

    def count(batches):
        at, bucket = None, None

        def done() -> Iterator[pa.RecordBatch]:
            spread = shared.value
            for langs, phrases, f, d in bucket.prefixes():
                keep = f >= least
                if d < most and spread:  # other buckets may have more of these
                    first = phrases if d == 1 else pc.list_element(pc.split_pattern(phrases, " ", max_splits=1), 0)
                    keep |= np.fromiter(((a, b) in spread for a, b in zip(langs.to_pylist(), first.to_pylist(), strict=True)), bool, len(f))
                keep = np.flatnonzero(keep)
                take = pa.array(keep)
                yield pa.RecordBatch.from_arrays([langs.take(take), phrases.take(take), pa.array(np.full(len(keep), d, np.int32)), pa.array(f[keep])], ["lang", "phrase", "words", "f"])

        for b in batches:
            for i, k in enumerate(b.column(0).to_pylist()):
                if k != at:
                    if bucket is not None:
                        yield from done()
                    at, bucket = k, Bucket(most)
                lists = [b.column(c)[i].values for c in range(1, 5)]
                bucket.add(lists[0], lists[1], lists[2].to_numpy(), lists[3].to_numpy())
        if bucket is not None:
            yield from done()

    n = min(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = _blocks(docs, hot, buckets, most).repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket")
    found = dealt.mapInArrow(count, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def scored(known: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of the phrases of two words or more in known, by their worst cut."""
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice("_w", a, n), " ")
    cut = known.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), words.alias("_w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    side = lambda name, f: bounded(known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f)))
    met = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr("(cast(1000000 as decimal(38,0)) * a * a) div (cast(l as decimal(38,0)) * r)")
    worst = met.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_c"))
    return worst.select("lang", "phrase", "words", "a", "_c.l", "_c.r", "_c.score")


def alone(candidates: DataFrame, inside: int = INSIDE, most: int = MOST) -> DataFrame:
    """Candidates that lie in no longer one with at least `inside` percent of their count."""
    if most < 3:
        return candidates
    pairs = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))))
    within = candidates.filter("words > 2").select("lang", "words", F.col("a").alias("longer"), F.split("phrase", " ").alias("_w")).select("lang", "longer", F.explode(pairs).alias("phrase"))
    most_of = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    met = candidates.join(most_of, ["lang", "phrase"], "left")
    return met.filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * inside)).drop("longer")


def best(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` candidates of each language with their rank. Lists of hashed parts are merged FAN_IN at a time, so no task sorts a language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        place = F.row_number().over(Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(parts))).orderBy(*order))
        candidates = candidates.withColumn("_place", place).filter(F.col("_place") <= top).drop("_place")
        parts //= FAN_IN
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, top: int = TOP, inside: int = INSIDE, text: str = "text", lang: str = "lang", bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first `top` phrases of 2 to `most` words of each language."""
    spark = docs.sparkSession
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    read = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    single = written(totals(read), "phrases-words")
    n = single.groupBy("lang").agg(F.sum("f").alias("n"))
    total = single.agg(F.sum("f")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_words))
    hot = [(r.lang, r.word) for r in single.filter(F.col("f") > total / (2 * buckets)).select("lang", "word").collect()]  # 2 * buckets at most
    known = written(counts(read, hot, buckets, least, most), "phrases-counts")
    found = best(alone(scored(known), inside, most), top)
    by_lang = written(n, "phrases-languages")
    forget(single)
    return found.join(bounded(by_lang), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded), range(1, {MOST} + 1) t(k) WHERE i + k - 1 <= len(w)
), counts AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), cuts AS (
  SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM counts WHERE k > 1 AND f >= {LEAST}
), scored AS (
  SELECT x.lang, x.words, x.phrase, x.a, min(struct_pack(score := (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT, c := c, l := l.f, r := r.f)) AS m
  FROM cuts x JOIN counts l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1 : x.c], ' ') JOIN counts r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.c + 1 :], ' ')
  GROUP BY x.lang, x.words, x.phrase, x.a
), kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM scored b WHERE b.lang = s.lang AND b.words = 3 AND s.words = 2 AND 100 * b.a >= {INSIDE} * s.a
      AND (s.phrase = array_to_string(string_split(b.phrase, ' ')[1 : 2], ' ') OR s.phrase = array_to_string(string_split(b.phrase, ' ')[2 : 3], ' ')))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY m.score DESC, a DESC, phrase) AS rank, phrase, a, m.l AS l, m.r AS r, n, m.score AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""
