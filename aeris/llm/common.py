"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.session import checkpoint_root, materialize

#: the word rule of this subpackage: maximal runs of digits, ASCII letters and non-ASCII bytes
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
              for b in range(256))


_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers (``addPyFile``), once per application. Needless but
    harmless where the package is installed on the executors or was given with ``--py-files``.

    Where the session says nothing of the size of Arrow batches they get ``BATCH_ROWS`` rows: Spark's own 10,000 texts
    stand in memory up to four times (both ways, in the JVM and in Python)."""
    import tempfile
    import zipfile
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="aeris-py-"), "aeris.zip")  # on the driver, which serves it
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The given Parquet table, read by Spark (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: the lineage ends in files that
    outlive executors, and later steps do not repeat the work."""
    return materialize(df, name)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names starting like ``wanted`` that ``df`` does not have (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``."""
    return text.translate(_WORD).split()


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if t is None else t for t in column.cast(kind).to_pylist()]


def sliced(batches, max_bytes: int = 16 << 20, column: int = 1):
    """Cut Arrow batches so that the texts in ``column`` of each piece hold about ``max_bytes``
    at most (a single longer text is its own piece)."""
    import pyarrow.compute as pc
    for b in batches:
        if b.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), dtype=np.int64)
        start, total = 0, 0
        for i, s in enumerate(sizes):
            if i > start and total + s > max_bytes:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += s
        yield b.slice(start)


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgets all when it holds ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        self[word] = h
        return h


_HASHES = WordHashes()


def word_hashes(text: bytes) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def forget() -> None:
    """At the end of a task, free what it remembered and give memory back to the system: Python workers live on and
    are used again by other stages."""
    import ctypes
    import gc

    import pyarrow as pa
    _HASHES.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; a text with fewer words has one
    shingle of all its words, a text without words none. Equal hashes count as equal shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    acc = np.zeros(n, dtype=np.uint64)
    for i in range(min(size, len(h))):
        acc = mix(acc + h[i:i + n]) + np.uint64(i + 1)
    return np.unique(acc)


def connected(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (64-bit ids): ``(node, root)`` with the smallest id of
    each component, for every id on an edge.

    Minimum labels travel over the edges and are then shortened by pointer jumping; each round is a
    written table. Rows per round: nodes plus edges. A node with very many edges only meets partial
    minimums and a join that Spark may split.
    """
    # written before they are used in both directions: a second computation could choose other edges
    one = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                 f"{name}-edges")
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")) \
        .select("node", F.least("node", "low").alias("root"))
    labels = stored(labels, f"{name}-labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("mid"))
        # jump: the label of my label (labels are ids on edges)
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        new = stored(step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("root")), f"{name}-labels")
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


__all__ = ["as_bytes", "checkpoint_root", "connected", "forget", "fresh", "mix", "os", "read_table", "shingles", "ship", "sliced",
           "stored", "word_hashes", "words_of"]
