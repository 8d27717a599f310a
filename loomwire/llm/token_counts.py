"""Token counts of whole texts under a unigram vocabulary, without building the tokens.

Blanks become the piece mark, with one before the text, as the vocabulary's tokenizer does. An
Aho-Corasick automaton enumerates the vocabulary's matches; dynamic programming over their ends carries
the best score and its number of pieces. Ties go as in the exact tokenizer: of equal scores the one
that was reached from the earliest start, thus by the longest last piece, stays. A character that is
no piece costs the lowest score less 10 and counts as its UTF-8 bytes if the vocabulary has byte pieces.

If no piece has a mark after another character, a best path never crosses a mark that begins a word;
words are then solved once and remembered (a bounded cache), else the text is solved as a whole.

Null and empty texts have 0 tokens and score 0, an empty table no rows. Repeated rows count alike; extra columns are
ignored. Very long texts are solved word by word, or whole in memory linear in their length.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: A public vocabulary that every machine of the cluster has; only the driver opens it.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value: the tokenizer's cost of an unknown character
CACHE = 300_000
_BY_WORD = re.compile(f"{MARK}+[^{MARK}]*")
_models: dict[int, "Viterbi"] = {}


class Vocabulary(NamedTuple):
    pieces: list[str]
    scores: list[float]
    byte_pieces: bool

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        """Ordinary pieces of a SentencePiece file. Placeholder scores (below -1e8) count as the lowest of the others."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = [sp.get_score(i) for i in ids]
        low = min(s for s in scores if s > -1e8)
        return cls([sp.id_to_piece(i) for i in ids], [max(s, low) for s in scores], any(sp.is_byte(i) for i in range(sp.get_piece_size())))


class Viterbi:
    def __init__(self, v: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(v.pieces, v.scores, strict=True):
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in v.pieces if len(p) == 1}
        self.unknown = min(v.scores) - UNKNOWN_PENALTY
        self.byte_pieces = v.byte_pieces
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in v.pieces)
        self.known: dict[str, tuple[float, int]] = {}

    def solve(self, s: str) -> tuple[float, int]:
        """Best score of s and the number of its pieces."""
        best, count = [0.0], [0]
        least = float("-inf")
        matches = self.automaton.iter(s)
        ahead = next(matches, None)
        for i, c in enumerate(s):
            top, longest, pieces = least, 0, 0
            while ahead is not None and ahead[0] == i:
                length, score = ahead[1]
                start = i + 1 - length
                t = best[start] + score
                if t > top or (t == top and length > longest):
                    top, longest, pieces = t, length, count[start] + 1
                ahead = next(matches, None)
            if c not in self.single:
                t = best[i] + self.unknown
                if t > top:
                    top, pieces = t, count[i] + (len(c.encode("utf-8", "surrogatepass")) if self.byte_pieces else 1)
            best.append(top)
            count.append(pieces)
        return best[-1], count[-1]

    def count(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        s = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.solve(s)
        if MARK + MARK in s:
            words = Counter(_BY_WORD.findall(s))
        else:
            words = Counter(s.split(MARK))
            del words[""]  # before the first mark
            words = {MARK + w: n for w, n in words.items()} | ({MARK: 1} if s[-1] == MARK else {})
        score, pieces = 0.0, 0
        known = self.known
        for w, n in words.items():
            got = known.get(w)
            if got is None:
                got = self.solve(w)
                if len(w) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[w] = got
            score += got[0] * n
            pieces += got[1] * n
        return score, pieces


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """doc_id, n_tokens and score of every row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        v = shared.value
        key = hash((len(v.pieces), v.pieces[0], v.pieces[-1], v.scores[-1], sum(v.scores), v.byte_pieces)) if v.pieces else 0
        if key not in _models:  # kept for the worker's next tasks
            _models.clear()
            _models[key] = Viterbi(v)
        solver = _models[key]
        for b in batches:
            got = [solver.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in got], pa.int64()), pa.array([s for s, _ in got], pa.float64())], ["doc_id", "n_tokens", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text)).mapInArrow(count, f"doc_id {kind}, n_tokens long, score double")
