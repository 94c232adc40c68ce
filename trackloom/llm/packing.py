"""Order-preserving packing of token streams by dynamic programming.

The documents of a partition, in their order, are one stream of ids.  Cuts may lie at ends of documents, at ends of sentences
and, inside very long sentences, every ``HARD_STEP`` ids.  The program chooses the cuts that minimise padding plus a
penalty per cut document and a constant per sequence.  Padding goes up to ``capacity``, except that a sequence whose length is
a power of two has none.  For a cut j at position c(j) the best predecessor i within ``capacity`` has the least f(i) + c(i),
which a monotone queue gives in constant time; predecessors at a power of two are looked up.

A partition is worked through in blocks of ``BLOCK_IDS`` ids.  A block is solved with all that is pending, all its sequences
but the last two are final, and the rest goes into the next block, so memory does not depend on the partition.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import cut, modest_batches, only, texts_of

CAPACITY = 4096
END_ID = 2
SENTENCE_PENALTY = 16
HARD_PENALTY = 64
HARD_STEP = 64
SEQUENCE_COST = 8
BLOCK_IDS = 1 << 19
#: Words that a worker remembers with their ids.
REMEMBERED = 500_000
MARKS = frozenset(".,!?;:")
#: Printable ASCII but the apostrophe, which may begin a piece of its own kind, and Latin letters: composing changes no such
#: word, lower case goes letter by letter, and the pieces are the runs of letters, the digits, the runs of marks.
PLAIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
PIECES = re.compile(r"[^\W\d_]+|[0-9]|(?:\W|_)+")
#: The letter that byte-level vocabularies write for each byte: printable Latin-1 stays, the others follow from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class KnownWords(dict):
    """Bytes of the 16-bit ids of words; a new word is looked up when it is first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        prefix = os.path.commonprefix(self.added) or ""
        #: What all of these tokens begin with, up to the first letter; "" is in every text.
        self.mark = "".join(itertools.takewhile(lambda c: c.lower() == c.upper(), prefix))

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if self.mark in word and self.holds_added(word):
            found = self.by_library(word)
        elif word.isascii() and word.isalpha():
            found = self.of_letters(word) if word.islower() else self[word.lower()]
        elif word[-1:] in MARKS and word[:-1].isascii() and word[:-1].isalpha():
            found = self[word[:-1]] + self[word[-1]]
        else:
            found = self.look_up(word)
        self[word] = found
        return found

    def holds_added(self, text: str) -> bool:
        """Whether a token of its own right may be in the text in some case; the library matches those letter by letter."""
        lower = text.lower()
        return any(t.lower() in lower for t in self.added)

    def by_library(self, word: str) -> bytes:
        return array("H", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def of_letters(self, letters: str) -> bytes:
        """Of one piece, in the letters of the byte alphabet."""
        return array("H", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def look_up(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            lower = word.lower()
            if lower != word:
                return self[lower]
            pieces = PIECES.findall(word)
            if len(pieces) > 1:
                return b"".join([self[p] for p in pieces])
            return self.of_letters(word if word.isascii() else "".join([BYTE_LETTERS[x] for x in word.encode()]))
        return self.by_library(word)


class WordTokenizer:
    """Ids of a lower-casing tokenizer whose tokens never cross white space, so texts are looked up word by word."""

    shared: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids must be below 65,536")
        self.known = KnownWords(tokenizer)
        self.ends_sentence = np.zeros(1 << 16, bool)
        for token, n in vocabulary.items():
            word = token.removesuffix("</w>")
            if word != token and word and not word.isalnum() and word.strip("\"')]}").endswith((".", "!", "?")):
                self.ends_sentence[n] = True

    @classmethod
    def at(cls, path: str) -> WordTokenizer:
        if path not in cls.shared:
            cls.shared[path] = cls(path)
        return cls.shared[path]

    def encode(self, text: str) -> np.ndarray:
        """The 16-bit ids of a text."""
        if text.isascii() and not (self.known.mark in text and self.known.holds_added(text)):
            text = text.lower()
        return np.frombuffer(b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" "))), np.uint16)


def best_cuts(positions: np.ndarray, penalties: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """Indices of the chosen cuts, the last one included.  ``positions`` rise from 0 in steps of at most ``capacity``."""
    n = len(positions)
    at, cost = positions.tolist(), penalties.tolist()
    ends, begins = [], []
    size = 1
    while size <= capacity:
        where = np.searchsorted(positions, positions - size)
        met = np.flatnonzero(positions[where] == positions - size)
        ends.append(met)
        begins.append(where[met])
        size *= 2
    end, begin = np.concatenate(ends), np.concatenate(begins)
    order = np.argsort(end, kind="stable")
    exact_end, exact_begin, e = [*end[order].tolist(), n], begin[order].tolist(), 0
    best, back = [0] * n, [0] * n
    # the queue: candidates with rising value f(i) + c(i), from head on
    queued, values, head = [0], [0], 0
    for j in range(1, n):
        c = at[j]
        first = c - capacity
        while at[queued[head]] < first:
            head += 1
        i = queued[head]
        least = values[head] - first
        while exact_end[e] == j:
            k = exact_begin[e]
            e += 1
            if best[k] <= least:
                least, i = best[k], k
        least += cost[j]
        best[j], back[j] = least, i
        value = least + c
        while len(values) > head and values[-1] >= value:
            values.pop()
            queued.pop()
        values.append(value)
        queued.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def cut_places(ids: np.ndarray, ends: np.ndarray, ends_sentence: np.ndarray, hard_step: int = HARD_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may lie, from 0 to the end, and the cost of a sequence that ends there."""
    sentences = np.flatnonzero(ends_sentence[ids]) + 1
    whole = np.unique(np.concatenate([[0], sentences, ends]))
    gaps = np.diff(whole)
    long = np.flatnonzero(gaps > hard_step)
    hard = np.concatenate([np.arange(whole[g] + hard_step, whole[g + 1], hard_step) for g in long]) if len(long) else np.empty(0, np.int64)
    positions = np.unique(np.concatenate([whole, hard])).astype(np.int64)
    penalties = np.full(len(positions), HARD_PENALTY + SEQUENCE_COST)
    penalties[np.searchsorted(positions, sentences)] = SENTENCE_PENALTY + SEQUENCE_COST
    penalties[np.searchsorted(positions, ends)] = SEQUENCE_COST
    return positions, penalties


class Stream:
    """Documents that wait for their sequences."""

    def __init__(self, ends_sentence: np.ndarray, first_sequence: int, capacity: int = CAPACITY):
        self.ends_sentence, self.sequence, self.capacity = ends_sentence, first_sequence, capacity
        self.waiting: list[tuple[int | None, np.ndarray, int]] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.waiting.append((doc_id, np.append(ids, np.uint16(END_ID)), 0))
        self.size += len(ids) + 1

    def pack(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Pieces of the sequences that are final now; with ``last`` those of all."""
        if not self.waiting:
            return
        ids = np.concatenate([x[start:] for _, x, start in self.waiting])
        ends = np.cumsum([len(x) - start for _, x, start in self.waiting])
        positions, penalties = cut_places(ids, ends, self.ends_sentence)
        bounds = positions[best_cuts(positions, penalties, self.capacity)]
        if not last:
            bounds = bounds[:-2]
        if not len(bounds):
            return
        total = int(bounds[-1])
        edges = np.unique(np.concatenate([[0], bounds, ends[ends < total]]))
        begin, end = edges[:-1], edges[1:]
        doc, sequence = np.searchsorted(ends, begin, side="right"), np.searchsorted(bounds, begin, side="right")
        doc_from, sequence_from = np.concatenate([[0], ends])[doc], np.concatenate([[0], bounds])[sequence]
        skipped = np.array([start for _, _, start in self.waiting])
        wide = ids.astype("<u4")
        sums = [zlib.crc32(wide[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        yield pa.record_batch(
            [
                pa.array([self.waiting[d][0] for d in doc], pa.int64()), pa.array(begin - doc_from + skipped[doc]), pa.array(end - begin),
                pa.array(sums, pa.int64()), pa.array([len(self.waiting[d][1]) for d in doc], pa.int64()),
                pa.array(sequence + self.sequence), pa.array(begin - sequence_from),
            ],
            names=[f.split()[0] for f in FIELDS.split(", ")],
        )
        self.sequence += len(bounds)
        kept = int(np.searchsorted(ends, total, side="right"))
        rest = self.waiting[kept:]
        if rest and total > (ends[kept - 1] if kept else 0):
            doc_id, x, start = rest[0]
            rest[0] = (doc_id, x, start + total - int(ends[kept - 1] if kept else 0))
        self.waiting, self.size = rest, self.size - total


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each partition of ``docs`` is packed in its order; nothing is shuffled.  Sequence ids are unique over all partitions.  A null
    or empty text is the one end id.  Repeated rows are packed each; a null doc_id stays null.  No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.at(tokenizer_path)
        stream = Stream(words.ends_sentence, TaskContext.get().partitionId() << 33, capacity)
        for batch in batches:
            for piece in cut(batch, 1 << 20):
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts_of(piece), strict=True):
                    stream.add(doc_id, words.encode(text))
                if stream.size >= BLOCK_IDS:
                    yield from stream.pack(last=False)
        yield from stream.pack(last=True)

    modest_batches(docs.sparkSession)
    return only(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text")).mapInArrow(run, FIELDS)
