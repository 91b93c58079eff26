"""Exact dedup with a two-pass Bloom filter.

Pass 1 hashes every text once (only ids, lengths and digests are kept) and sets bits of two filters:
"seen" and "seen again". Pass 2 tests every digest against "seen again": a digest all of whose bits were
hit twice is possibly repeated. Only those rows (without their texts) are shuffled and grouped by digest;
all others pass straight through.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``; null counts as
empty. Of equal texts the row with the most code points stays, then the smallest id (a null id loses),
then one of fully equal rows. Every row of the input has one row in the result, repeated rows too; an
empty table gives an empty result. Other columns of the input are ignored.

The filter has ``BITS_PER_ROW`` bits for every row, rounded up to a power of two, and at most ``FILTER_BITS`` (64 MB;
about 7 in 10,000 different rows are "possibly repeated" up to 67 million rows, 7 in 100 at four times as many). More
rows than it was made for make more rows "possibly repeated", which costs shuffle and never changes the result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeris.llm.common import as_bytes, forget, fresh, stored

FILTER_BITS = 1 << 29
BITS_PER_ROW = 8
PROBES = 2
_CHUNK_BITS = 1 << 20
_BLANK = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text.translate(None, _BLANK)).digest()


def code_points(text: bytes) -> int:
    return len(text.translate(None, _CONTINUATION))


def bits_for(rows: int, most: int = FILTER_BITS) -> int:
    """Bits of the filter for a counted number of rows."""
    return min(most, max(_CHUNK_BITS, 1 << (BITS_PER_ROW * rows - 1).bit_length()))


def _prints(batches):
    for b in batches:
        texts = as_bytes(b.column(1))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([digest(t) for t in texts], pa.binary()),
             pa.array([code_points(t) for t in texts], pa.int64())], names=["id", "sha", "n_cp"])
    forget()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, sha, n_cp, row)``, written once; ``row`` tells repeated rows apart."""
    two = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = two.mapInArrow(_prints, "id long, sha binary, n_cp long")
    return stored(prints.withColumn("row", F.monotonically_increasing_id()), "exact-prints")


def _slots(shas, bits: int) -> np.ndarray:
    """``PROBES`` filter positions of each digest, one column per probe."""
    words = np.frombuffer(b"".join(s[:8 * PROBES] for s in shas), dtype="<u8").reshape(-1, PROBES)
    return (words % np.uint64(bits)).astype(np.int64)


def repeated_bits(prints: DataFrame, bits: int) -> dict[int, bytes]:
    """The "seen again" filter as ``{chunk: packed bits}``; at most ``bits / 8`` bytes in all."""

    def local(batches):  # one filter pair per task: bytes of eight bits, chunks that were hit
        seen: dict[int, np.ndarray] = {}
        again: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            for probe in _slots(b.column(0).to_pylist(), bits).T:
                # repeats within the batch, then against what came before
                slot, n = np.unique(probe, return_counts=True)
                for c in np.unique(slot // _CHUNK_BITS).tolist():
                    mine = slot // _CHUNK_BITS == c
                    byte, bit = _bit(slot[mine] % _CHUNK_BITS)
                    if c not in seen:
                        seen[c], again[c] = np.zeros(_CHUNK_BITS // 8, np.uint8), np.zeros(_CHUNK_BITS // 8, np.uint8)
                    more = (n[mine] > 1) | (seen[c][byte] & bit > 0)
                    np.bitwise_or.at(again[c], byte[more], bit[more])
                    np.bitwise_or.at(seen[c], byte, bit)
        yield from _packed(seen, again)
        forget()

    def merged(batches):
        seen: dict[int, np.ndarray] = {}
        again: dict[int, np.ndarray] = {}
        for b in batches:
            for c, s, a in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s, a = _unpacked(s), _unpacked(a)
                if c in seen:
                    again[c] |= a | (seen[c] & s)
                    seen[c] |= s
                else:
                    seen[c], again[c] = s, a
        yield from _packed(seen, again)

    kind = "chunk int, seen binary, again binary"
    chunks = -(-bits // _CHUNK_BITS)
    rows = prints.select("sha").mapInArrow(local, kind).repartition(chunks, "chunk").mapInArrow(merged, kind)
    return {r.chunk: r.again for r in rows.select("chunk", "again").collect()}


def _packed(seen, again):
    for c in seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(c)], pa.int32()), pa.array([zlib.compress(seen[c].tobytes(), 1)]),
             pa.array([zlib.compress(again[c].tobytes(), 1)])], names=["chunk", "seen", "again"])


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).copy()


def _bit(slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return slot >> 3, (1 << (slot & 7)).astype(np.uint8)


class Filter:
    """The broadcast "seen again" filter, unpacked where it is used."""

    def __init__(self, prints: DataFrame, bits: int | None = None):
        self.bits = bits or bits_for(prints.count())
        self.shared = prints.sparkSession.sparkContext.broadcast(repeated_bits(prints, self.bits))

    def test(self):
        """A function from digests to booleans, for one task."""
        table = np.zeros((self.bits + _CHUNK_BITS) // 8, np.uint8)
        for c, data in self.shared.value.items():
            table[c * _CHUNK_BITS // 8:(c + 1) * _CHUNK_BITS // 8] = _unpacked(data)

        def maybe(shas) -> np.ndarray:
            byte, bit = _bit(_slots(list(shas), self.bits))
            return (table[byte] & bit > 0).all(axis=1)
        return maybe

    def __getstate__(self):
        return {"shared": self.shared, "bits": self.bits}


def possibly_repeated(found: Filter):
    """A column function ``sha -> boolean``."""
    @F.arrow_udf("boolean")
    def test(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        maybe = found.test()
        for shas in parts:
            yield pa.array(maybe(shas.to_pylist()) if len(shas) else [], pa.bool_())
        forget()

    return test


def fingerprint_and_test(found: Filter):
    """A column function ``text -> struct<sha, maybe>``, one Python call for both. It is marked as not deterministic, so
    that a plan which uses both fields, and filters by one, still calls it once a row (and needs one worker a task)."""
    @F.arrow_udf("sha binary, maybe boolean")
    def marked(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        maybe = found.test()
        for texts in parts:
            shas = [digest(t) for t in as_bytes(texts)]
            yield pa.StructArray.from_arrays([pa.array(shas, pa.binary()), pa.array(maybe(shas) if shas else [], pa.bool_())],
                                             names=["sha", "maybe"])
        forget()

    return marked.asNondeterministic()


def grouped(maybe: DataFrame) -> DataFrame:
    """One row per digest: size and the row that stays."""
    best = F.max(F.struct("n_cp", (-F.col("id")).alias("neg"), (-F.col("row")).alias("neg_row")))
    return maybe.groupBy("sha").agg(F.count(F.lit(1)).alias("size"), best.alias("best")) \
        .select("sha", "size", (-F.col("best.neg")).alias("keep_id"), (-F.col("best.neg_row")).alias("keep_row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                filter_bits: int | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    prints = fingerprints(docs, id_col, text_col)
    test = possibly_repeated(Filter(prints, filter_bits))
    flagged = prints.withColumn("maybe", test("sha"))
    alone = flagged.where(~F.col("maybe")).select(
        F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    maybe = flagged.where("maybe").drop("maybe")
    # groups are written on their own, so that the join's two sides are plain shuffles and a hot digest can be split
    rest = maybe.join(stored(grouped(maybe), "exact-groups"), "sha").select(
        F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return alone.unionByName(rest)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             filter_bits: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were. Rows whose digest
    cannot be repeated pass through without a shuffle; the rest meet the rows that stay by (digest, id)."""
    cols = docs.columns
    prints = fingerprints(docs, id_col, text_col)
    found = Filter(prints, filter_bits)
    kept = stored(grouped(prints.where(possibly_repeated(found)("sha"))), "exact-kept")
    mark, sha_name, key_name, id_name = fresh(docs, "_mark", "_sha", "_keep_sha", "_keep_id")
    flagged = docs.withColumn(mark, fingerprint_and_test(found)(F.col(text_col))).withColumn(sha_name, F.col(mark)["sha"])
    maybe = F.col(mark)["maybe"]
    straight = flagged.where(~maybe).select(*cols)
    right = kept.select(F.col("sha").alias(key_name), F.col("keep_id").alias(id_name))
    rest = flagged.where(maybe).join(
        right, (F.col(sha_name) == F.col(key_name)) & F.col(id_col).cast("long").eqNullSafe(F.col(id_name)), "left_semi")
    # the kept id may stand on shorter variants or repeated rows of its group: the longest one stays
    length = F.length(F.coalesce(F.col(text_col), F.lit("")))
    one = rest.groupBy(sha_name).agg(F.max_by(F.struct(*cols), length).alias(key_name)).select(f"{key_name}.*")
    return straight.unionByName(one)
