"""Removal of long repeated byte strings (suffix-array dedup) by sparse prefix doubling.

A byte goes if it is covered by a ``length``-byte string (200) that also starts anywhere else, in the same document or
another one; overlaps count and strings are judged on the input. Equal strings are found by ranks that are refined
at growing lengths, as in prefix doubling, until a position is unique or past the threshold:

1. Every string of ``length`` bytes is represented by one of its ``GRAM``-byte substrings, the one with the least
   hash (leftmost on ties). Equal strings choose equal substrings at equal offsets, so only one position in about
   eighty, an *anchor*, enters the sort. An anchor stands for a run of consecutive string starts; its *segment* is
   the bytes of all of them.
2. Anchors are dealt and sorted by (rank of the gram, rank of the segment). A gram alone in its rank is
   unique: all strings of the segment are unique. Equal segments make all their strings repeated.
3. Segments that share a gram and differ are refined: their strings, ranked by all ``length`` bytes and
   the gram, are counted; ranks held by two or more are repeated.

Ranks are 64-bit hashes of content, always compared together with the gram's (128 bits in all), so a rank
needs no global renumbering. A document is known by its id and a 64-bit hash of id and text together.

Passages held by very many documents do not meet in one task. A task gives a segment twice at most (as far as its
tables of fixed size remember), and ``HOT`` different segments of a gram: the next one tells all others that
the gram is hot, and those after it are dealt by gram and segment. Segments of a gram that has more than ``_GROUP`` are
compared about ``_GROUP`` at a time; then the strings still alone, and one of each found again, are counted by
string, with partial sums, so that it does not matter where they were dealt to.

Null and empty texts have no bytes and keep none; texts shorter than ``length`` are kept whole. Repeated rows are
documents of their own. Bytes are those of the UTF-8 text; what remains may not be valid UTF-8 and is
returned as digest or, with ``with_bytes``, as binary. Other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aeris.llm.common import as_bytes, forget, mix, sliced, stored

LENGTH = 200
GRAM = 40
_BUFFER = 1 << 19  # bytes worked on at once
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = np.uint64((1 << 23) - 1)  # low bits of a key: the place in the buffer


class Met:
    """What a task has given so far, in tables of fixed size that forget by overwriting: how often a segment was given (0,
    1, or 2: as repeated), and how many segments of a gram."""

    def __init__(self, bits: int = 17):
        self.shift = np.uint64(64 - bits)
        self.g, self.e, self.gram = (np.zeros(1 << bits, np.uint64) for _ in range(3))
        self.times, self.count = np.zeros(1 << bits, np.int8), np.zeros(1 << bits, np.int64)

    def segments(self, g: np.ndarray, e: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """How often each of these different segments was given before; they are given once more."""
        slot = (mix(g ^ mix(e)) >> self.shift).astype(np.int64)
        before = np.where((self.g[slot] == g) & (self.e[slot] == e), self.times[slot], 0)
        self.g[slot], self.e[slot], self.times[slot] = g, e, np.minimum(2, before + 1 + repeated)
        return before

    def grams(self, g: np.ndarray) -> np.ndarray:
        """For each segment given, how many of its gram were given before it."""
        if not len(g):
            return np.zeros(0, np.int64)
        order = np.argsort(g, kind="stable")
        head = np.flatnonzero(np.r_[True, g[order][1:] != g[order][:-1]])
        size = np.diff(np.r_[head, len(g)])
        one = g[order][head]
        slot = (mix(one) >> self.shift).astype(np.int64)
        base = np.where(self.gram[slot] == one, self.count[slot], 0)
        self.gram[slot], self.count[slot] = one, base + size
        at = np.empty(len(g), np.int64)
        at[order] = np.repeat(base - head, size) + np.arange(len(g))
        return at


class Rolling:
    """Hashes of substrings of a buffer: ``sum(value[byte] * base ** place)`` modulo 2**64, shifted to place 0."""

    _powers: tuple[np.ndarray, np.ndarray] | None = None
    _values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def __init__(self, data: np.ndarray):
        up, self.down = self.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._values[data] * up[:len(data)], out=self.sums[1:])

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls._powers is None or len(cls._powers[0]) < n:
            size = max(n, _BUFFER + 4096)
            inverse = pow(_BASE, -1, 1 << 64)
            cls._powers = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, inverse))
        return cls._powers

    def at(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def every(self, n: int, count: int) -> np.ndarray:
        """Hashes of the substrings of ``n`` bytes that start at 0, ..., ``count - 1``."""
        return mix((self.sums[n:n + count] - self.sums[:count]) * self.down[:count])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values: block-wise running minimums from both sides."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:len(x)] = x
    grid = padded.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def anchors(data: np.ndarray, valid: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """``first, count, g, e``: runs of string starts with the same anchor; ``valid`` tells which starts
    count (a string that crosses the end of a document does not)."""
    n = len(data) - length + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    if n <= 0 or not valid.any():
        return none
    rolling = Rolling(data)
    grams = rolling.every(gram, len(data) - gram + 1)
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_min(key, length - gram + 1) & _PLACE).astype(np.int64)
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, n])
    first, count = first[valid[first]], count[valid[first]]
    offset = place[first] - first
    g = grams[place[first]]
    e = rolling.at(first, first + count - 1 + length)
    e = mix(e + offset.astype(np.uint64) * np.uint64(0x9E3779B1) + count.astype(np.uint64) * np.uint64(0x85EBCA77C2B2AE63))
    return first, count, g, e


def buffers(texts: list[bytes], length: int = LENGTH):
    """Texts joined into buffers of about ``_BUFFER`` bytes: ``(data, owners, starts, valid)``, where ``owners[i]`` is
    the text that lies at ``starts[i]`` of the buffer and ``begin`` bytes into its own. Longer texts are spread over
    several buffers that overlap by ``length - 1`` bytes, so that every string start is valid in exactly one."""
    part: list[bytes] = []
    owner: list[int] = []
    begin: list[int] = []
    size = 0

    def flush():
        data = np.frombuffer(b"".join(part), np.uint8)
        sizes = np.array([len(p) for p in part], np.int64)
        start = np.cumsum(sizes) - sizes
        valid = np.zeros(max(0, len(data) - length + 1), bool)
        for s, m in zip(start.tolist(), sizes.tolist(), strict=True):
            valid[s:max(s, s + m - length + 1)] = True
        return data, np.array(owner), start, np.array(begin, np.int64), valid

    for i, t in enumerate(texts):
        at = 0
        while len(t) - at >= length:
            piece = t[at:at + _BUFFER]
            if part and size + len(piece) > _BUFFER:
                yield flush()
                part, owner, begin, size = [], [], [], 0
            part.append(piece)
            owner.append(i)
            begin.append(at)
            size += len(piece)
            at += _BUFFER - length + 1 if len(piece) == _BUFFER else len(t)
    if part:
        yield flush()


_PLAIN, _KNOWN, _DONE = 0, 1, 2
_GROUP = 1000
HOT = 32
_HOT, _SPREAD = 1, 2  # flags of an anchor
_DEALS = 4096  # parts of a hot gram


def anchor_rows(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(key, doc, g, e, packed)`` of every anchor of ``texts(key, doc, text)``. ``packed`` holds the first string start,
    the number of starts, flags and a state. Segments a task has not given yet have a row that may meet others
    (``_KNOWN``: it is repeated already); the others are settled (``_DONE``), joined to runs, with their number
    of starts in ``e``. The flag ``_HOT`` marks the segment of a gram that follows ``hot`` others of the task,
    ``_SPREAD`` those after it."""
    def run(batches):
        met = Met()
        for b in sliced(batches, 4 << 20, column=2):
            keys, docs = np.asarray(b.column(0)), np.asarray(b.column(1))
            for data, owner, start, begin, valid in buffers(as_bytes(b.column(2)), length):
                first, count, g, e = anchors(data, valid, length, gram)
                if not len(first):
                    continue
                at = np.searchsorted(start, first, side="right") - 1
                key, doc, place = keys[owner[at]], docs[owner[at]], first - start[at] + begin[at]
                _, lead, where, n = np.unique(g ^ mix(e), return_index=True, return_inverse=True, return_counts=True)
                before = met.segments(g[lead], e[lead], n > 1)
                leads = np.zeros(len(g), bool)
                leads[lead[before < 2]] = True
                state = np.where((n > 1) | (before > 0), _KNOWN, _PLAIN)[where]
                done = np.flatnonzero(~leads)
                if len(done):  # runs of neighbours
                    ends = place[done] + count[done]
                    new = np.r_[True, (owner[at[done]][1:] != owner[at[done]][:-1]) | (place[done][1:] != ends[:-1])]
                    head = np.flatnonzero(new)
                    total = np.add.reduceat(count[done], head)
                    head = done[head]
                    far = mix(key[head].view(np.uint64) + place[head].astype(np.uint64))  # dealt anywhere
                    yield _rows(key[head], doc[head], far, total, _packed(place[head], 0, 0, _DONE))
                nth = met.grams(g[leads])
                flags = np.where(nth > hot, _SPREAD, np.where(nth == hot, _HOT, 0))
                yield _rows(key[leads], doc[leads], g[leads], e[leads], _packed(place[leads], count[leads], flags, state[leads]))
        forget()

    return texts.mapInArrow(run, "key long, doc long, g long, e long, packed long")


def _packed(first, n, flags, state) -> np.ndarray:
    return (first.astype(np.int64) << 20) | (n << 11) | (flags << 2) | state


def _rows(key, doc, g, e, packed):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (key, doc, g, e, packed)],
                                      names=["key", "doc", "g", "e", "packed"])


def ranked(rows: DataFrame) -> DataFrame:
    """Anchors that are not unique: ``repeated`` (all strings of the segment are), and ``open``: one row of each
    different segment of a gram that has several (``group`` of them; null for a hot gram, whose equal segments may have
    several open rows, see ``counted``)."""
    gram, segment = Window.partitionBy("g", "s"), Window.partitionBy("g", "s", "e")
    state, flags = F.col("packed").bitwiseAND(3), F.shiftright("packed", 2).bitwiseAND(3)
    part = F.when(flags == _SPREAD, F.pmod(F.col("e"), F.lit(_DEALS)) + 1).otherwise(0).cast("int")
    # dealt by the gram once: that holds for its segments as well
    both = rows.withColumn("s", part).repartition("g", "s") \
        .withColumn("k", F.row_number().over(segment.orderBy("key", "doc", "packed"))) \
        .withColumn("same", F.count(F.lit(1)).over(segment)).withColumn("known", F.max(state).over(segment)) \
        .withColumn("group", F.sum((F.col("k") == 1).cast("int")).over(gram)).withColumn("hot", F.max(flags).over(gram))
    done = state == _DONE
    repeated = (F.col("same") > 1) | (F.col("known") > 0)
    group = F.when(F.col("hot") == 0, F.col("group"))
    return both.withColumn("group", group).select(
        "key", "doc", "g", F.shiftright("packed", 20).alias("first"),
        F.when(done, F.col("e")).otherwise(F.shiftright("packed", 11).bitwiseAND(511)).alias("n"),
        repeated.alias("repeated"), (~done & (F.coalesce("group", F.lit(2)) > 1) & (F.col("k") == 1)).alias("open"), "group") \
        .where("repeated or open")


def counted(open_: DataFrame) -> DataFrame:
    """Open rows with their ``group``; the parts of a hot gram are added up."""
    hot = open_.where("group is null").drop("group")
    total = hot.groupBy("g").agg(F.count(F.lit(1)).alias("group"))
    return open_.where("group is not null").unionByName(hot.join(total, "g"))


def segment_bytes(texts: DataFrame, open_: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(g, key, doc, first, n, group, bytes)``: open segments with their bytes; ``texts`` holds ``(key, doc,
    packed_text)``."""
    lists = open_.groupBy("key", "doc").agg(F.collect_list(F.struct("g", "first", "n", "group")).alias("segs"))

    def run(batches):
        import pyarrow as pa
        for b in sliced(batches, 1 << 20, column=2):
            out: list[list] = [[] for _ in range(7)]
            columns = (b.column(0).to_pylist(), b.column(1).to_pylist(), _unpack(b.column(2)), b.column(3).to_pylist())
            for key, doc, text, segs in zip(*columns, strict=True):
                for x in segs:
                    values = (x["g"], key, doc, x["first"], x["n"], x["group"], text[x["first"]:x["first"] + x["n"] - 1 + length])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            types = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)],
                                             names=["g", "key", "doc", "first", "n", "group", "bytes"])
        forget()

    return texts.select("key", "doc", "packed_text").join(lists, ["key", "doc"]) \
        .mapInArrow(run, "g long, key long, doc long, first long, n long, group long, bytes binary")


def _strings(n: np.ndarray, data: list[bytes], length: int):
    """Hashes of all ``length``-byte strings of segments, with the segment each belongs to and its place there."""
    joined = np.frombuffer(b"".join(data), np.uint8)
    sizes = np.array([len(x) for x in data], np.int64)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = begin[owner] + within
    return Rolling(joined).at(at, at + length), owner, within


def refined(segments: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(key, doc, first, n)``: runs of repeated strings of the open segments."""
    kind = "key long, doc long, first long, n long"

    def together(batches):
        held: list[tuple] = []
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(6)), strict=True))
            for row in rows:
                if held and row[0] != held[-1][0] and len(held) >= 2000:
                    yield _repeated_runs(held, length)
                    held = []
                held.append(row)
        if held:
            yield _repeated_runs(held, length)
        forget()

    few = segments.where(F.col("group") <= _GROUP).drop("group").repartition("g").sortWithinPartitions("g") \
        .mapInArrow(together, kind)

    def parts(batches):
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                held.append(row)
                if len(held) >= 2000:
                    yield _compared(held, length)
                    held = []
        if held:
            yield _compared(held, length)
        forget()

    large = segments.where(F.col("group") > _GROUP)
    part = F.pmod(F.xxhash64("key", "doc", "first"), F.ceil(F.col("group") / _GROUP))
    large = large.withColumn("part", part).drop("group").repartition("g", "part").sortWithinPartitions("g", "part") \
        .select("g", "key", "doc", "first", "n", "bytes")
    each = stored(large.mapInArrow(parts, "g long, h long, kind int, key long, doc long, first long, n long"), "repeat-strings")
    strings = each.where(F.col("kind") != _RUN)
    twice = strings.groupBy("g", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g", "h")
    columns = ["key", "doc", "first", "n"]
    return few.unionByName(each.where(F.col("kind") == _RUN).select(*columns)) \
        .unionByName(strings.where(F.col("kind") == _ALONE).join(twice, ["g", "h"]).select(*columns))


_RUN, _ALONE, _ONE_OF = 0, 1, 2


def _found(rows: list[tuple], length: int):
    """All strings of segments ``(g, key, doc, first, n, bytes)``: ``g, h, key, doc, first`` of each, the segment it belongs
    to, how many equal it, and the first of each kind."""
    g, key, doc, first, n = (np.array([r[i] for r in rows], np.int64) for i in range(5))
    h, owner, within = _strings(n, [r[5] for r in rows], length)
    _, lead, where, count = np.unique(mix(h + mix(g.view(np.uint64)[owner])), return_index=True, return_inverse=True,
                                      return_counts=True)
    return (g[owner], h.view(np.int64), key[owner], doc[owner], first[owner] + within), owner, count[where], lead


def _runs(owner: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of neighbouring strings of a segment among ``again`` (places) begin, and their lengths."""
    new = np.r_[True, (owner[again][1:] != owner[again][:-1]) | (np.diff(again) > 1)][:len(again)]
    head = np.flatnonzero(new)
    return again[head], np.diff(np.r_[head, len(again)])


def _repeated_runs(rows: list[tuple], length: int):
    import pyarrow as pa
    (_, _, *place), owner, count, _ = _found(rows, length)
    at, size = _runs(owner, np.flatnonzero(count > 1))
    return pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in place), pa.array(size)], names=["key", "doc", "first", "n"])


def _compared(rows: list[tuple], length: int):
    """Runs of the strings that are repeated among these segments, the strings that are alone, and one of each repeated."""
    import pyarrow as pa
    columns, owner, count, lead = _found(rows, length)
    at, size = _runs(owner, np.flatnonzero(count > 1))
    alone, one_of = np.flatnonzero(count == 1), lead[count[lead] > 1]
    every = np.r_[at, alone, one_of]
    kind = np.repeat(np.array([_RUN, _ALONE, _ONE_OF], np.int32), [len(at), len(alone), len(one_of)])
    n = np.r_[size, np.ones(len(alone), np.int64), np.zeros(len(one_of), np.int64)]
    g, h, key, doc, first = (pa.array(x[every]) for x in columns)
    return pa.RecordBatch.from_arrays([g, h, pa.array(kind), key, doc, first, pa.array(n)],
                                      names=["g", "h", "kind", "key", "doc", "first", "n"])


def _unpack(column) -> list[bytes]:
    import zstandard
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x) for x in column.to_pylist()]


def packed_texts(docs: DataFrame) -> DataFrame:
    """``docs(key, doc_id, text)`` with the text compressed, for the shuffles by key."""
    def run(batches):
        import pyarrow as pa
        import zstandard
        pack = zstandard.ZstdCompressor(level=1)
        for b in sliced(batches, 4 << 20, column=2):
            data = pa.array([pack.compress(x) for x in as_bytes(b.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), data], names=["key", "doc_id", "packed_text"])

    return docs.mapInArrow(run, "key long, doc_id long, packed_text binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   with_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``) of every row of ``docs``."""
    id_ = F.col(id_col).cast("long")
    own = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), id_.alias("doc_id"),
                      F.col(text_col).alias("text"))
    doc = F.coalesce("doc_id", F.lit(-1).cast("long")).alias("doc")  # the key tells a null id from -1
    found = stored(ranked(anchor_rows(own.select("key", doc, "text"), length, hot=hot)), "repeat-ranks")
    texts = packed_texts(own).select("*", doc)
    runs = found.where("repeated").select("key", "doc", "first", "n").unionByName(
        refined(segment_bytes(texts, counted(found.where("open")), length), length))
    lists = runs.groupBy("key", "doc").agg(F.collect_list(F.struct("first", "n")).alias("runs"))

    def cut(batches):
        import pyarrow as pa
        for b in sliced(batches, 1 << 20):
            out: list[list] = [[] for _ in range(6)]
            for doc, text, spans in zip(b.column(0).to_pylist(), _unpack(b.column(1)), b.column(2).to_pylist(), strict=True):
                merged = _merged(spans or [], length)
                kept, at = [], 0
                for s, e in merged:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                rest = b"".join(kept)
                values = (doc, len(text), len(text) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            m = 6 if with_bytes else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:m], types[:m], strict=True)], names=names[:m])
        forget()

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return texts.join(lists, ["key", "doc"], "left").select("doc_id", "packed_text", "runs").mapInArrow(cut, kind)


def _merged(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by strings of ``length`` bytes at the starts of ``spans``."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["first"], x["first"] + x["n"] - 1 + length) for x in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out
