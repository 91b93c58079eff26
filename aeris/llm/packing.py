"""Packing of tokenised documents into sequences by length patterns.

A document is its token ids and a closing id 0. Documents longer than ``capacity`` are cut into pieces of that
many ids, the last one shorter. Pieces are packed whole:

1. a histogram of piece lengths (at most ``capacity`` numbers) is counted;
2. patterns of two or three lengths that fill a sequence exactly are priced against the histogram, and repeat
   counts for the best ones are fitted by non-negative least squares; counts are rounded down to what is there;
3. what is left is packed by best fit, longest first, counts of equal lengths at once;
4. the pieces of each length are numbered in parallel (counts per salted part, then positions in the part), and
   a piece's number picks its sequence and offset from the plan.

The plan depends on the histogram alone: its size is bounded by the capacity, whatever the number of documents.
If the fitted patterns need more sequences than best fit alone, the fit is left out.

Null and empty texts are the single id 0. Repeated rows are packed each on its own. Other columns are
ignored; an empty table gives an empty result. Tokenising remembers the ids of blank-separated words (the
tokenizer's pre-tokeniser never joins across blanks), up to ``_REMEMBER`` words a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from itertools import islice
from unicodedata import is_normalized

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aeris.llm.common import forget, sliced, stored

CAPACITY = 2048
_REMEMBER = 250_000
_PART = 50_000


class WordTokens:
    """Ids of texts through remembered ids of their blank-separated words.

    Texts are lower-cased as the tokenizer does, and full stops and commas at the end of a word become words of
    their own, which they are to the tokenizer unless they follow another sign; texts where they do, and those with
    special strings or a capital sigma, go to the tokenizer whole. New words are tokenised together: words of letters joined by blanks and told apart again
    by the end mark that each one's last id carries, all others one by one."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        # the same model for lower-cased, NFC words of letters: splitting at blanks is all that is left to do
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.at = _Numbered()
        for w in ("", ".", ","):
            self.at[w] = len(self.at)
        point, comma = (self._whole(x) for x in ".,")
        self.flat = np.r_[point, comma].astype(np.uint32)
        self.size = np.array([0, len(point), len(comma)])
        self.start = np.array([0, 0, len(point)])
        self.sign = np.array([False, True, True])  # words that end in a sign

    def _forget(self) -> None:
        """Drop the words beyond the first ``_REMEMBER``, which hold the frequent ones."""
        if len(self.at) > _REMEMBER:
            for w in list(islice(reversed(self.at), len(self.at) - _REMEMBER)):
                del self.at[w]
            self.size, self.start, self.sign = (x[:_REMEMBER].copy() for x in (self.size, self.start, self.sign))
            self.flat = self.flat[:int((self.start + self.size).max())].copy()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, words: list[str]) -> None:
        size = np.zeros(len(words), np.int64)
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        letters = np.fromiter((w.isalpha() and (w.isascii() or is_normalized("NFC", w)) and w == w.lower() for w in words),
                              bool, len(words))
        plain, odd = np.flatnonzero(letters), np.flatnonzero(~letters).tolist()
        lines = [plain[i:i + 64] for i in range(0, len(plain), 64)]
        text = [" ".join([words[i] for i in line]) for line in lines]
        for line, e in zip(lines, self.letters.encode_batch_fast(text, add_special_tokens=False), strict=True):
            own = np.array(e.ids, np.uint32)
            stops = np.flatnonzero(self.ends[own]) + 1
            if len(stops) == len(line):
                size[line] = np.diff(stops, prepend=0)
                ids[line[0]] = own  # the ids of the whole line, at its first word
            else:
                odd += line.tolist()
        order = np.argsort(~letters, kind="stable")  # lines one after the other, then the others
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False), strict=True):
            ids[i] = np.array(e.ids, np.uint32)
            size[i] = len(ids[i])
        start = np.empty(len(words), np.int64)
        start[order] = len(self.flat) + np.cumsum(size[order]) - size[order]
        self.flat = np.concatenate([self.flat, *(ids[i] for i in order.tolist())])
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        sign = np.fromiter((not w[-1].isalnum() for w in words), bool, len(words))
        self.sign = np.concatenate([self.sign, sign])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        self._forget()
        # special strings keep their case and a final sigma is lowered by what stands around it: the tokenizer's work
        special = [i for i, t in enumerate(texts) if t and ("<|" in t or "\u03a3" in t)]
        split = [self._words(t or "") for t in texts]
        for i in special:
            split[i] = [""]
        words = [w for s in split for w in s]
        index = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        if self.at.new:
            self._learn(self.at.new)
            self.at.new = []
        ends = np.cumsum([len(s) for s in split])
        # a stop or comma after another sign belongs to it
        joined = np.flatnonzero(self.sign[index[:-1]] & ((index[1:] == 1) | (index[1:] == 2))) + 1 if len(index) else []
        whole = np.union1d(np.searchsorted(ends, joined, side="right"), special).astype(int).tolist()
        size = self.size[index]
        upto = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[index] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        if not whole:
            return ids, np.diff(upto[ends - 1], prepend=0) if len(ends) else np.zeros(0, np.int64)
        parts = np.split(ids, upto[ends - 1][:-1])
        for i in whole:
            parts[i] = self._whole(texts[i])
        return np.concatenate(parts), np.array([len(x) for x in parts])

    @staticmethod
    def _words(text: str) -> list[str]:
        text = text.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return (text + " ").replace(". ", " . ").replace(", ", " , ").split(" ")


class _Numbered(dict):
    """Numbers words in the order in which they are first asked for, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, row, piece, start, length, ids_crc32`` (and ``ids``) of every piece; ``row`` tells repeated
    documents apart."""
    kind = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        import pyarrow as pa
        tokens = WordTokens(tokenizer_path)  # for this task: Python workers are used again by other stages
        for b in sliced(batches, 1 << 20):
            ids, per = tokens.encode(b.column(1).to_pylist())
            ids = ids.astype("<u4")
            at = 0
            out: list[list] = [[] for _ in range(6 + with_ids)]
            for doc, row, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), per.tolist(), strict=True):
                own = np.append(ids[at:at + n], np.uint32(0)).astype("<u4")
                at += n
                for k, s in enumerate(range(0, n + 1, capacity)):
                    part = own[s:s + capacity]
                    for column, value in zip(out, (doc, row, k, s, len(part), zlib.crc32(part.tobytes()), part.tolist() if with_ids else None),
                                             strict=False):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=names[:len(out)])
        del tokens
        forget()

    three = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                        F.monotonically_increasing_id().alias("row"))
    return three.mapInArrow(run, kind)


# ---------------------------------------------------------------- the plan (histogram only)

def _fitted(counts: np.ndarray, capacity: int, rounds: int = 6, batch: int = 64) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of two or three lengths that fill a sequence, with repeat counts from non-negative least squares
    (columns are added by their gradient, then all weights are refitted), rounded down to what is there."""
    h = counts[:capacity].astype(float)
    n = np.arange(capacity)
    third = capacity - n[:, None] - n[None, :]  # length that completes a pair
    valid = (n[:, None] >= 1) & (n[None, :] >= n[:, None]) & ((third >= n[None, :]) | (third == 0))
    rows: list[tuple[int, ...]] = []
    known: set[tuple[int, ...]] = set()
    matrix = np.zeros((0, capacity))
    x = np.zeros(0)
    for _ in range(rounds):
        left = h - x @ matrix
        have = np.where(h > 0, left, -np.inf)
        have[0] = 0.0  # no third document
        gain = have[:, None] + have[None, :] + have[np.clip(third, 0, capacity - 1)]
        size = np.where(third == 0, 2, 3)
        gain = np.where(valid, gain / np.sqrt(size), -np.inf)
        top = np.argpartition(gain.ravel(), -batch)[-batch:] if gain.size > batch else np.arange(gain.size)
        added = 0
        for k in top[np.argsort(-gain.ravel()[top], kind="stable")]:
            a, b = divmod(int(k), capacity)
            pattern = tuple(v for v in (a, b, capacity - a - b) if v > 0)
            if gain.ravel()[k] <= 1e-9 or pattern in known or sum(pattern) != capacity:
                continue
            known.add(pattern)
            rows.append(pattern)
            added += 1
        if not added:
            break
        matrix = np.zeros((len(rows), capacity))
        for i, p in enumerate(rows):
            np.add.at(matrix[i], list(p), 1.0)
        x = _nnls(matrix, h, np.r_[x, np.zeros(added)])
    free = counts.copy()
    out = []
    for i in np.argsort(-x, kind="stable"):
        need = np.bincount(rows[i])
        lengths = np.flatnonzero(need)
        times = int(min(int(x[i] + 1e-6), *(free[lengths] // need[lengths])))
        if times > 0:
            free[lengths] -= times * need[lengths]
            out.append((rows[i], times))
    return out


def _nnls(matrix: np.ndarray, target: np.ndarray, x: np.ndarray, sweeps: int = 25) -> np.ndarray:
    """min |x @ matrix - target| with x >= 0, by coordinate descent on the normal equations."""
    gram, goal = matrix @ matrix.T, matrix @ target
    gradient = gram @ x - goal
    for _ in range(sweeps):
        moved = 0.0
        for i in range(len(x)):
            new = max(0.0, x[i] - gradient[i] / gram[i, i])
            if new != x[i]:
                gradient += (new - x[i]) * gram[i]
                moved = max(moved, abs(new - x[i]))
                x[i] = new
        if moved < 0.25:
            break
    return x


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit on counts, longest lengths first: bins of equal content are one entry with a count."""
    by_room: list[list[list]] = [[] for _ in range(capacity + 1)]  # room -> [pattern, bins]
    for length in range(capacity, 0, -1):
        todo = int(counts[length])
        room = length
        while todo:
            while room <= capacity and not by_room[room]:
                room += 1
            if room > capacity:  # new bins, filled with as many of this length as go in
                k = capacity // length
                bins, rest = divmod(todo, k)
                if bins:
                    by_room[capacity - k * length].append([(length,) * k, bins])
                if rest:
                    by_room[capacity - rest * length].append([(length,) * rest, 1])
                break
            pattern, bins = by_room[room][-1]
            k = min(room // length, todo)
            use = min(bins, todo // k)
            if use == bins:
                by_room[room].pop()
            else:
                by_room[room][-1][1] -= use
            by_room[room - k * length].append([pattern + (length,) * k, use])
            todo -= use * k
    return [(tuple(p), n) for room in by_room for p, n in room]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """``(pattern, repeats)`` covering ``counts[length]`` pieces of each length exactly."""
    counts = np.asarray(counts, np.int64)
    full = int(counts[capacity])
    rest = counts.copy()
    rest[capacity] = 0
    alone = _best_fit(rest, capacity)
    fitted = _fitted(rest, capacity)
    left = rest.copy()
    for p, n in fitted:
        np.subtract.at(left, list(p), n)
    both = fitted + _best_fit(left, capacity)
    chosen = both if sum(n for _, n in both) <= sum(n for _, n in alone) else alone
    return ([((capacity,), full)] if full else []) + chosen


def places(chosen: Iterable[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first numbers, first sequences and offsets of the runs of equal places."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in chosen:
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            runs.setdefault(length, []).append((first, sequence, offset))
            used[length] = first + times
            offset += length
        sequence += times
    return {length: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for length, r in runs.items()}


# ---------------------------------------------------------------- placing the pieces

def numbered(cut: DataFrame) -> DataFrame:
    """``cut`` with ``number``: 0, 1, 2, ... among the pieces of the same length. Salted parts of about ``_PART``
    pieces are numbered on their own; their offsets come from counts."""
    parts = max(8, cut.count() // _PART)
    salted = cut.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")) \
        .select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("length", "part").orderBy("row", "piece")
    return salted.withColumn("k", F.row_number().over(inside)).join(offsets, ["length", "part"]) \
        .withColumn("number", F.col("offset") + F.col("k") - 1).drop("k", "offset", "part")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) of every piece."""
    cut = stored(pieces(docs, tokenizer_path, capacity, id_col, text_col, with_ids), "pack-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    runs = docs.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    plain = numbered(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "number", *["ids"] * with_ids)

    def place(batches):
        import pyarrow as pa
        for b in batches:
            length, number = np.asarray(b.column(3)), np.asarray(b.column(5))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                first, seq, off = runs.value[int(n)]
                at = np.searchsorted(first, number[mine], side="right") - 1
                sequence[mine] = seq[at] + number[mine] - first[at]
                offset[mine] = off[at]
            extra = [b.column(6)] if with_ids else []
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset), *extra], names=names)
        forget()

    kind = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
            + ", ids array<int>" * with_ids)
    return plain.mapInArrow(place, kind)
