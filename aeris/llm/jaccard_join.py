"""N-gram Jaccard join by chosen paths.

A document is its set of five-word shingles; two documents are linked when the Jaccard similarity of their sets is
``threshold`` (0.8) or more. Candidates come from a chosen-path join: each set is embedded as ``COORDINATES``
min-hash tokens, and every run splits the sets recursively. A node of the recursion, the path of tokens so far,
draws a few coordinates at random (the same for all sets at the node) and sends each set on by its token there. Sets
that meet at a node of at most ``BUCKET`` members are compared by brute force (in blocks of ``BLOCK``); larger nodes
are split again. A
linked pair survives a run of two levels with at least ``threshold ** 2``, so ``runs`` is chosen to miss it with a
probability below ``1 - recall`` (0.99999: 12 runs). Deeper levels lose more, so sets in a node that was split again
take part in as many more runs as the target needs at ``DEPTH`` levels.

Candidate pairs (similarity of the tokens minus five deviations) only say which documents belong together
tentatively. All documents of such a component are then compared exactly, so a link inside a component
is found whether or not its two documents ever met. Components larger than ``BLOCK`` are compared block by block,
links are counted and only a spanning forest of them leaves a task. Equal sets are one member with a count.

Words: A-Z lower-cased, runs of digits, ASCII letters and non-ASCII characters. A text of one to four words is a
single shingle; a text without words (null, empty) is linked to nothing. Sets are compared by 64-bit hashes of
their shingles. Repeated rows count as documents of their own; a null id is never a class id unless the whole
class has none; other columns are ignored or kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeris.llm.common import as_bytes, connected, forget, fresh, mix, shingles, sliced, stored

SIZE = 5
THRESHOLD = 0.8
RECALL = 0.99999
COORDINATES = 64
WAVE = 4
BUCKET = 4000
BLOCK = 400
DEPTH = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_EXTRA = np.uint64(int(0.25 / COORDINATES * 2 ** 64))
_ODD = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, COORDINATES + 1001, dtype=np.uint64))


def runs_for(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold ** 2)))


def missed(runs: int, depth: int, threshold: float = THRESHOLD) -> float:
    """Probability that a pair at ``threshold`` meets in no run: agreeing tokens are binomial, and the nodes that two
    sets share are a branching process with the children of ``children``."""
    extra, total = 0.25 / COORDINATES, 0.0
    for k in range(COORDINATES + 1):
        agree, lost = k / COORDINATES, 0.0
        for _ in range(depth):
            one = 1 - agree + agree * lost
            lost = one * (1 - extra + extra * one) ** (COORDINATES - 1)
        total += math.comb(COORDINATES, k) * threshold ** k * (1 - threshold) ** (COORDINATES - k) * lost ** runs
    return total


def more_runs(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs beyond ``runs_for`` that keep the target at ``depth`` levels."""
    runs = first = runs_for(threshold, recall)
    while missed(runs, depth, threshold) > 1 - recall and runs < 100 * first:
        runs += 1
    return runs - first


def tokens(values: np.ndarray) -> np.ndarray:
    """Min-hash tokens of a non-empty set of hashes."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 2048):
        np.minimum(low, (values[at:at + 2048, None] * _ODD + _ADD).min(axis=0), out=low)
    return mix(low)


def children(path: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next nodes of sets at ``path``: row numbers and paths. A node draws the coordinate with the least hash, and
    each other one with probability 0.25 / COORDINATES: 1.25 = 1 / 0.8 children on average."""
    coordinate = np.arange(1, COORDINATES + 1, dtype=np.uint64) * _STEP
    draw = mix(path[:, None] + coordinate)
    row, i = np.nonzero((draw == draw.min(axis=1, keepdims=True)) | (draw < _EXTRA))
    return row, mix(path[row] ^ mix(values[row, i] + coordinate[i]))


def sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, runs: int | None = None) -> DataFrame:
    """``(key, doc_id, n, same, tokens, paths, later)`` of every row: a key of id and text, the number of shingles, a
    digest of the set, one byte per token, and its nodes after two levels of the first ``WAVE`` runs and of the
    others."""
    roots = mix(np.arange(1, (runs or runs_for()) + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def run(batches):
        import pyarrow as pa
        import xxhash
        for b in sliced(batches, 2 << 20, column=2):
            n, same, low = [], [], []
            for text in as_bytes(b.column(2)):
                s = shingles(text, size)
                n.append(len(s))
                same.append(xxhash.xxh3_128_digest(s.tobytes()))
                low.append(tokens(s) if len(s) else np.zeros(COORDINATES, np.uint64))
            values = np.array(low)
            nodes = []
            for part in (roots[:WAVE], roots[WAVE:]):
                row = np.repeat(np.flatnonzero(n), len(part))
                path = np.tile(part, np.count_nonzero(n))
                for _ in range(2):
                    at, path = children(path, values[row])
                    row = row[at]
                nodes.append([np.unique(x).view(np.int64) for x in np.split(path, np.searchsorted(row, np.arange(1, len(n))))])
            small = (values & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(same, pa.binary()),
                 pa.array([x.tobytes() for x in small], pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in nodes)],
                names=["key", "doc_id", "n", "same", "tokens", "paths", "later"])
        forget()

    three = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).cast("long").alias("doc_id"),
                        F.col(text_col).alias("text"))
    return three.mapInArrow(run, "key long, doc_id long, n int, same binary, tokens binary, paths array<long>, later array<long>")


def _groups(batches, n_keys: int, at_least: int = 4096):
    """Rows (tuples) of sorted batches, cut between different values of the first ``n_keys`` columns."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
            if len(held) >= at_least and row[:n_keys] != held[-1][:n_keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _bounds(keys: list) -> list[tuple[int, int]]:
    cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    return [(a, b) for a, b in zip(cut, cut[1:], strict=False) if b - a > 1]


def _forest(near: np.ndarray) -> np.ndarray:
    """Smallest index that each index is connected to (``near``: symmetric adjacency)."""
    label = np.arange(len(near))
    near = near | np.eye(len(near), dtype=bool)
    while True:
        low = np.where(near, label[None, :], len(near)).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def candidate_edges(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges ``(a, b)`` between members ``(path, lo, hi, side, key, group, tokens)`` of a node whose tokens agree often
    enough for a link; a spanning forest per node. Members of one ``group`` are connected already, and edges join
    groups. ``lo < hi`` are two blocks of one large node: only edges that
    join what is not connected within either block are given."""
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / COORDINATES)

    def run(batches):
        import pyarrow as pa
        for rows in _groups(batches, 3):
            group = np.array([r[5] for r in rows], np.int64)
            side = np.array([r[3] for r in rows], np.int32)
            mark = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(-1, COORDINATES)
            a, b = [], []
            for s, e in _bounds([r[:3] for r in rows]):
                if e - s == 2:
                    if group[s] != group[s + 1] and (mark[s] == mark[s + 1]).mean() >= least:
                        a.append(group[s:s + 1])
                        b.append(group[s + 1:e])
                    continue
                part, mine = mark[s:e], group[s:e]
                if (mine == mine[0]).all():
                    continue
                near = np.stack([(part == x).mean(axis=1) >= least for x in part]) | (mine[:, None] == mine[None, :])
                own = mine[:, None] == mine[None, :]
                if rows[s][1] != rows[s][2]:  # each block's own components come from its own pair
                    own |= near & (side[s:e, None] == side[None, s:e])
                label, own = _forest(near), _forest(own)
                other = np.flatnonzero((label != np.arange(e - s)) & (own == np.arange(e - s)))
                a.append(mine[label[other]])
                b.append(mine[other])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
        forget()

    order = ["path", "lo", "hi"]
    return members.select(*order, "side", "key", "group", "tokens").repartition(*order).sortWithinPartitions(*order, "key") \
        .mapInArrow(run, "a long, b long")


def _blocked(members: DataFrame, node: str, count: str, block: int) -> DataFrame:
    """Members of a node dealt to pairs of blocks of about ``block`` members (one pair for a small node)."""
    blocks = F.ceil(F.col(count) / block).cast("int")
    mine = F.pmod(F.xxhash64("key", F.lit(11)), blocks).cast("int")
    return members.withColumn("side", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))) \
        .withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other")).drop("other")


def candidates(reps: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Tentative components ``(node, root)`` of distinct sets ``(key, tokens, paths, later)``. The first runs connect most
    of what belongs together; the others only add edges between the components found so far. Members of nodes that were
    split below two levels take part in more runs."""
    split: list[DataFrame] = []
    marks = reps.select("key", "tokens")
    first = candidate_edges(_members(reps.select("key", F.explode("paths").alias("path")), marks, split)
                            .withColumn("group", F.col("key")), threshold)
    found = connected(first, "join-first")

    def grouped(members: DataFrame) -> DataFrame:
        return members.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("group", F.coalesce("root", "key"))

    more = candidate_edges(grouped(_members(reps.select("key", F.explode("later").alias("path")), marks, split)), threshold)
    n = more_runs(threshold, recall)
    if split and n:
        keys = split[0]
        for other in split[1:]:
            keys = keys.unionByName(other)
        roots = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)).view(np.int64).tolist()
        starts = marks.join(keys.distinct(), "key", "left_semi") \
            .select("key", F.explode(F.array(*(F.lit(x) for x in roots))).alias("path"), "tokens")
        nodes = _split(_split(starts).join(marks, "key"))
        more = more.unionByName(candidate_edges(grouped(_members(nodes, marks, [])), threshold))
    return connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "join-candidates")


def _members(nodes: DataFrame, marks: DataFrame, split: list[DataFrame]) -> DataFrame:
    """Members ``(path, lo, hi, side, key, tokens)`` to compare of ``nodes(key, path)``: nodes of up to ``BUCKET``
    members; larger ones are split again by the next tokens, and taken as they are after ``DEPTH`` levels. Adds
    the keys of split nodes to ``split``."""
    ready: list[DataFrame] = []
    for depth in range(2, DEPTH + 1):
        nodes = stored(nodes, "join-nodes")
        sizes = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        shared = stored(nodes.join(sizes, "path"), "join-shared")
        last = depth == DEPTH
        ready.append(_blocked(shared if last else shared.where(F.col("c") <= BUCKET), "path", "c", BLOCK))
        if last or (large := shared.where(F.col("c") > BUCKET)).isEmpty():
            break
        if depth == 2:  # those split again are among them
            split.append(large.select("key"))
        nodes = _split(large.select("key", "path").join(marks, "key"))
    members = ready[0]
    for more in ready[1:]:
        members = members.unionByName(more)
    return members.join(marks, "key")


def _split(members: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        for b in batches:
            if not b.num_rows:
                continue
            values = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, COORDINATES).astype(np.uint64)
            keys = np.asarray(b.column(0))
            for at in range(0, len(keys), 4096):
                row, path = children(np.asarray(b.column(1))[at:at + 4096].view(np.uint64), values[at:at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + 4096][row]), pa.array(path.view(np.int64))],
                                                 names=["key", "path"])
        forget()

    return members.select("key", "path", "tokens").mapInArrow(run, "key long, path long")


def linked(members: DataFrame, size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """Exact links of members ``(root, lo, hi, side, key, copies, packed_text)`` of a component, block pair by block
    pair: ``(key, top, links)`` with the smallest member the key is connected to there and the documents linked to it
    across the pair (or inside the block where ``lo = hi``)."""
    num = int(round(threshold * 1000))

    def run(batches):
        import pyarrow as pa
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        for rows in _groups(batches, 3, at_least=256):
            for s, e in _bounds([r[:3] for r in rows]):
                part = sorted(rows[s:e], key=lambda r: r[4])
                own = [shingles(unpack.decompress(r[6]), size) for r in part]
                n = np.array([len(x) for x in own], np.int64)
                common = _intersections(own)
                near = common * 1000 >= num * (n[:, None] + n[None, :] - common)
                np.fill_diagonal(near, False)
                if part[0][1] != part[0][2]:
                    side = np.array([r[3] for r in part])
                    near &= side[:, None] != side[None, :]
                keys = np.array([r[4] for r in part], np.int64)
                links = near @ np.array([r[5] for r in part], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys[_forest(near)]), pa.array(links)],
                                                 names=["key", "top", "links"])
        forget()

    order = ["root", "lo", "hi"]
    return members.select(*order, "side", "key", "copies", "packed_text").repartition(*order).sortWithinPartitions(*order) \
        .mapInArrow(run, "key long, top long, links long")


def _intersections(own: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, by products of slices of the incidence matrix."""
    m = len(own)
    owner = np.repeat(np.arange(m), [len(x) for x in own])
    _, column, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    rank = np.cumsum(count > 1) - 1
    owner, column = owner[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), np.int64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        part = np.zeros((m, width), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    from aeris.llm.repeats import packed_texts
    return packed_texts(docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"),
                                    F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
            threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``(key, doc_id, n, root, n_links)`` of every row, written once: rows of a class have the same root."""
    all_sets = stored(sets(docs, id_col, text_col, size, runs_for(threshold, recall)), "join-sets")
    wordy = all_sets.where("n > 0")
    same = wordy.groupBy("same").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"))
    same = stored(same, "join-same")
    firsts = same.select(F.col("rep").alias("key"))
    reps = wordy.select("key", "tokens", "paths", "later").join(firsts, "key", "left_semi").dropDuplicates(["key"])
    found = candidates(stored(reps, "join-reps"), threshold, recall)
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("c"))
    members = found.withColumnRenamed("node", "key").join(sizes, "root") \
        .join(same.select(F.col("rep").alias("key"), "copies"), "key")
    texts = _packed(docs, id_col, text_col).select("key", "packed_text")
    whole = texts.join(members, "key").dropDuplicates(["key"])
    exact = stored(linked(_blocked(whole, "root", "c", BLOCK), size, threshold), "join-links")
    joined = connected(exact.select(F.col("key").alias("a"), F.col("top").alias("b")), "join-classes")
    links = exact.groupBy("key").agg(F.sum("links").alias("links"))
    per_rep = same.join(links.withColumnRenamed("key", "rep"), "rep", "left") \
        .join(joined.select(F.col("node").alias("rep"), "root"), "rep", "left") \
        .select("same", F.coalesce("root", "rep").alias("root"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rest = all_sets.where("n = 0").select("key", "doc_id", "n", F.lit(None).cast("long").alias("root"),
                                          F.lit(0).cast("long").alias("n_links"))
    return stored(wordy.select("key", "doc_id", "n", "same").join(per_rep, "same")
                  .select("key", "doc_id", "n", "root", "n_links").unionByName(rest), "join-result")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                 threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, n_links, class_size`` of every row: the smallest id of its class, and the documents it is
    linked to directly."""
    rows = classes(docs, id_col, text_col, size, threshold, recall)
    named = rows.where("root is not null").groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(named, "root", "left").select(
        "doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_links",
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
             threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest id; all columns as they were. Rows without
    words all stay."""
    rows = classes(docs, id_col, text_col, size, threshold, recall).where("root is not null")
    # a null id loses against every other
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    (key,) = fresh(docs, "_row_key")
    gone = rows.join(first.select("root", F.col("best.key").alias("stays")), "root").where("key <> stays") \
        .select(F.col("key").alias(key)).distinct()
    gone = stored(gone, "join-gone")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    kept = keyed.join(gone, key, "left_anti")
    if not rows.groupBy("key").count().where("count > 1").isEmpty():  # repeated rows: one of them
        wordless = rows.select("key").distinct().withColumnRenamed("key", key)
        kept = kept.join(wordless, key, "left_semi").dropDuplicates([key]) \
            .unionByName(kept.join(wordless, key, "left_anti"))
    return kept.select(*docs.columns)
