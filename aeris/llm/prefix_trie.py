"""Prefix trie of conversations by van Emde Boas recursion.

Conversations are first rebuilt: the first h turns of a shared opening conversation, then their own turns after the
first h (``rebuilt``). The trie of the rebuilt turn sequences has a node per distinct sequence of first d turns, from
the textless root; a conversation is a member of all nodes on its path.

The recursion cuts sequences of up to H turns (a power of two above the longest) at H / 2. The sequences up to the cut
make the upper trie; each distinct cut prefix gets a name and is the root of a lower trie over the turns behind the
cut. Upper and lower tries are built in the same way, all of one height in the same Spark job. A depth d is cut at
the height of its lowest set bit m, so its name is made from the name at d - m and the m turns behind it; after log2 H
jobs every place of every path has its node's name (``names``). Totals go back up in log2 H jobs (``grafted``): a
trie of height 2m takes the totals of its lower tries, found at their roots, and adds them to the at most m nodes
above each root. So a path of n turns costs about n log n small rows, where adding up all ancestors would cost n * n.

A name is two 64-bit hashes of (name at the cut above, xors of hashes of position and turn), 128 bits in all, and a
turn counts by such hashes of role and text; equal names count as the same prefix.

Ties: turns are ordered by ``turn`` (null first), ties by the hashes of role and text (no text is shuffled); repeated
rows are turns of their own. Null
roles and texts are empty. Rows without ``conv_id`` belong to no conversation and are left out; other columns are
ignored; an empty table gives no nodes, not even the root. A conversation of any length, a first turn or whole
conversation shared by any number of others, and an opening copied into many are spread: positions come from a range
sort, names and totals from sums that are combined before the shuffle, and the digest of a node's members (which has
one order) from slices of at most ``_SLICE`` sorted ids, so that one task meets few rows of a node.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aeris.llm.common import forget, stored
from aeris.session import scratch_path

OPENING = 100  # conversations that share an opening
SHARED = 6     # their number of shared turns is below this
_SLICE = 1 << 14


def opening(conv: Column) -> Column:
    return conv - conv % OPENING


def shared_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % SHARED


def placed(log: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """``conv, pos, h1, h2, chars``: every turn with its place (from 1), hashes and code points.

    The whole log is sorted once by range; a turn's place is its number in its sorted part and what earlier parts
    hold of the conversation, so a conversation of any length is split over parts."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    own = log.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(text, F.lit(7), role).alias("h2"), F.char_length(text).cast("long").alias("chars"))
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")]
    ranked = stored(own.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "h1", "h2", "chars"), "trie-ranked")
    parts = ranked.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("conv", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return ranked.join(starts, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "h1", "h2", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv, n, pos, h1, h2, chars`` of the rebuilt conversations, and ``conv, n`` of all, turnless ones too: the
    first ``shared_turns`` turns of the opening conversation (all if it has fewer, none if it is absent), then the
    own turns after as many."""
    one = F.struct("pos", "h1", "h2", "chars")
    lent = turns.where((F.col("pos") < SHARED) & (F.col("conv") == opening(F.col("conv")))).groupBy("conv") \
        .agg(F.sort_array(F.collect_list(one)).alias("lent")).withColumnRenamed("conv", "base")  # fewer than SHARED each
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("own"))
    convs = stored(sizes.withColumn("base", opening(F.col("conv"))).withColumn("h", shared_turns(F.col("conv"))).join(lent, "base", "left")
                   .withColumn("lent", F.slice(F.coalesce("lent", F.array().cast("array<struct<pos:long,h1:long,h2:long,chars:long>>")),
                                               F.lit(1), F.col("h").cast("int")))
                   .withColumn("n", F.size("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-convs")
    begin = convs.select("conv", "n", F.explode("lent").alias("t")).select("conv", "n", "t.*")
    shift = convs.where("own > h").select("conv", "n", "h", (F.size("lent") - F.col("h")).alias("shift"))
    rest = turns.join(shift, "conv").where("pos > h") \
        .select("conv", "n", (F.col("pos") + F.col("shift")).alias("pos"), "h1", "h2", "chars")
    return begin.unionByName(rest), convs.select("conv", "n")


def height(sizes: DataFrame) -> int:
    """A power of two above the number of turns of any conversation."""
    return 1 << int(sizes.agg(F.max("n")).first()[0] or 0).bit_length()


def names(turns: DataFrame, top: int) -> DataFrame:
    """``conv, n, depth, x1, x2, chars``: the name of the node of every place of every path, cut from the top down. Each
    height is written beside the ones before it, and all are read as one table."""
    spark = turns.sparkSession
    root, levels, done = scratch_path(spark, "trie-names"), [], None
    m = top // 2
    while m:
        # the upper tries of height m below a cut of height 2m that is reached
        upper = turns.withColumn("block", F.floor((F.col("pos") - 1) / m)).where(f"block % 2 = 0 and (block + 1) * {m} <= n")
        cuts = upper.groupBy("conv", "block").agg(
            F.bit_xor(F.xxhash64("pos", "h1")).alias("s1"), F.bit_xor(F.xxhash64("h2", "pos")).alias("s2"), F.max("n").alias("n"),
            F.max(F.when(F.col("pos") % m == 0, F.col("chars"))).alias("chars")) \
            .select("conv", "n", (F.col("block") * m).alias("above"), ((F.col("block") + 1) * m).alias("depth"), "s1", "s2", "chars")
        zero = F.lit(0).cast("long")
        rooted = cuts.where("above = 0").withColumn("r1", zero).withColumn("r2", zero)
        if done is not None:
            roots = done.select("conv", F.col("depth").alias("above"), F.col("x1").alias("r1"), F.col("x2").alias("r2"))
            rooted = rooted.unionByName(cuts.where("above > 0").join(roots, ["conv", "above"]))
        level = rooted.select("conv", "n", "depth", F.xxhash64("r1", "s1", "depth").alias("x1"),
                              F.xxhash64("depth", "s2", "r2").alias("x2"), "chars")
        levels.append(f"{root}/{m}")
        level.write.parquet(levels[-1])
        done = spark.read.schema(level.schema).parquet(*levels)
        m //= 2
    return done


def grafted(nodes: DataFrame, paths: DataFrame, top: int) -> DataFrame:
    """``x1, x2, n_leaves, saved`` of every node: sums over its subtree, from the bottom up.

    ``nodes``: ``x1, x2, conv`` (smallest member), ``depth, p1, p2`` (its parent), ``n_leaves, saved`` (its own);
    ``paths``: ``conv, depth, x1, x2`` of the smallest members."""
    total = nodes
    m = 1
    while m < top:
        # roots of lower tries of height m, at the cut of a trie of height 2m, and the sums of their first level
        lower = total.where((F.col("depth") - 1) % (2 * m) == m).groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")) \
            .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        roots = lower.join(nodes.where(F.col("depth") % (2 * m) == m).select("x1", "x2", "conv", "depth"), ["x1", "x2"]) \
            .select("conv", F.floor((F.col("depth") - 1) / m).alias("block"), "n_leaves", "saved")
        above = paths.withColumn("block", F.floor((F.col("depth") - 1) / m)).where("block % 2 = 0").select("conv", "block", "x1", "x2")
        more = above.join(roots, ["conv", "block"]).groupBy("x1", "x2") \
            .agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        total = stored(total.join(more, ["x1", "x2"], "left").withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)))
                       .withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0))).select(total.columns), f"trie-totals-{m}")
        m *= 2
    return total


def digests(ends: DataFrame) -> DataFrame:
    """``x1, x2, ends_sha256`` of ``ends(x1, x2, conv)``: SHA-256 of the ids in order, joined by commas.

    Ids are sorted by range over all tasks and joined in slices; then the few slices of a node are hashed in their
    order by one task, one after the other."""
    def slices(batches):
        import pyarrow as pa
        key, ids, begin = None, [], 0

        def row():
            return key[0], key[1], begin, ",".join(map(str, ids))

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 3, pa.string()), strict=True)],
                                              names=["x1", "x2", "first", "ids"])
        for b in batches:
            out = []
            for x1, x2, conv in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if key != (x1, x2) or len(ids) == _SLICE:
                    if ids:
                        out.append(row())
                    key, ids, begin = (x1, x2), [], conv
                ids.append(conv)
            if out:
                yield batch(out)
        if ids:
            yield batch([row()])
        forget()

    def hashed(batches):
        import pyarrow as pa

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)],
                                              names=["x1", "x2", "ends_sha256"])
        key, h = None, None
        for b in batches:
            out = []
            for x1, x2, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if key == (x1, x2):
                    h.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, h.hexdigest()))
                key, h = (x1, x2), hashlib.sha256(ids.encode())
            if out:
                yield batch(out)
        if key:
            yield batch([(*key, h.hexdigest())])
        forget()

    sliced = ends.select("x1", "x2", "conv").repartitionByRange("x1", "x2", "conv").sortWithinPartitions("x1", "x2", "conv") \
        .mapInArrow(slices, "x1 long, x2 long, first long, ids string")
    return stored(sliced, "trie-slices").repartition("x1", "x2").sortWithinPartitions("x1", "x2", "first") \
        .mapInArrow(hashed, "x1 long, x2 long, ends_sha256 string")


def trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """All nodes of the trie of ``turns(conv, n, pos, h1, h2, chars)``; ``sizes(conv, n)`` lists every conversation."""
    zero = F.lit(0).cast("long")
    top = height(sizes)
    paths = names(turns, top) if top > 1 else \
        sizes.limit(0).select("conv", "n", *(zero.alias(c) for c in ("depth", "x1", "x2", "chars")))
    key = ["x1", "x2"]
    found = paths.groupBy("depth", *key).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"),
                                             F.max("chars").alias("chars"))
    # the parent is the node before on the smallest member's path; at depth 1 it is the root
    before = paths.select("conv", (F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"))
    linked = found.join(before, ["conv", "depth"], "left").withColumn("p1", F.coalesce("p1", zero)).withColumn("p2", F.coalesce("p2", zero))
    root = sizes.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        "conv", "n_convs", *(zero.alias(c) for c in ("depth", "x1", "x2", "chars")),
        *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")))
    linked = stored(linked.unionByName(root), "trie-linked")
    parents = linked.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    children = linked.where("depth > 0").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(linked.join(children, key, "left").join(parents, ["p1", "p2"], "left")
                   .withColumn("n_children", F.coalesce("n_children", zero)).select(
        *key, "p1", "p2", "conv", "depth", "parent_conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "trie-nodes")
    below = nodes.where("depth > 0").drop("parent_conv_id", "n_convs", "n_children")
    firsts = below.select("conv").distinct()
    totals = grafted(below, paths.join(firsts, "conv", "left_semi").select("conv", "depth", *key), top)
    crown = totals.where("depth = 1").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")) \
        .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    own = nodes.where("depth = 0").select(*key, "n_leaves", "saved")
    sums = totals.select(*key, "n_leaves", "saved").unionByName(own.unionByName(crown).groupBy(*key).agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")))
    ends = paths.where("depth = n").select(*key, "conv").unionByName(sizes.where("n = 0").select(
        zero.alias("x1"), zero.alias("x2"), "conv"))
    return nodes.drop("n_leaves", "saved").join(sums, key).join(digests(ends), key, "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def prefix_trie(log: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node of the
    trie of the rebuilt conversations; a node is known by its smallest member and depth."""
    turns, sizes = rebuilt(stored(placed(log, conv_col, turn_col, role_col, text_col), "trie-placed"))
    return trie(stored(turns, "trie-turns"), sizes)
