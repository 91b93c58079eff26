"""Token counts of whole texts, huge ones in overlapping pieces.

Texts of up to ``CHUNK`` code points are counted whole (``WordCounts``). A longer one is cut into overlapping pieces which Spark
deals to tasks like any other rows; each is encoded on its own, with offsets. Two neighbours are spliced at a proven
common boundary, and the number of tokens is

    tokens of the last piece + sum over the splices p of (tokens left of p in the left piece - in the right piece).

Why a boundary is proven: a byte-level tokenizer without normaliser takes its special strings out of the text, splits
the rest into words by a pattern that is matched from left to right, and encodes each word by itself. The scan keeps
no state from word to word and looks no further back than the word's start, so two scans that both begin a word at a
place go on alike. It looks ahead by two code points at most, or by the length of the longest special string; so the
left piece's word starts are true ones as long as that many code points of it follow (``margin``). A place where both
pieces begin a word, that far before the left one's end, is therefore a word start of the whole text if the left
piece is true from its own splice on, which it is by induction from the first piece.

Where the pieces have no such place in common (one word, or one run of white space, covers the overlap), the overlap is
widened: the neighbours become one piece and are encoded again, until every splice is proven or one piece is left.
Tokenizers for which the proof does not hold (a normaliser, another splitter, special strings that take white space
along) encode every text whole.

Special strings inside texts are handled as the library does by default; truncation and padding are off, and no
special tokens are added. Null and empty texts have no tokens. Repeated rows give repeated rows; equal ids are told
apart. Other columns are ignored; an empty table gives an empty result. Memory per task: 1 MB of texts with their
tokens, or one piece (a longer one only where a word is longer than a piece).
"""

from __future__ import annotations

import json
from itertools import islice
from unicodedata import category

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aeris.llm.common import forget, sliced, stored

CHUNK = 1 << 15
OVERLAP = 1 << 9
_LOOK_AHEAD = 2
_LONG_WORD = 64
_NEVER = -(1 << 62)


def load(path: str):
    """The tokenizer of ``path``, without truncation and padding."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def margin(tokenizer) -> int | None:
    """How many code points must follow a word start for it to be sure; None where that is not known."""
    spec = json.loads(tokenizer.to_str())
    split = spec["pre_tokenizer"] or {}
    added = spec["added_tokens"]
    if (spec["normalizer"] is not None or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex")
            or (spec["post_processor"] or {}).get("type", "ByteLevel") != "ByteLevel"
            or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)):
        return None
    return max([_LOOK_AHEAD, *(len(a["content"]) for a in added)])


class WordCounts:
    """Tokens of whole texts through remembered counts of their words.

    The words are those that the tokenizer's own splitter makes (its published pattern, by the ``regex`` library), and
    each distinct one is encoded by the tokenizer once, alone: the splitter leaves a word as it is. Texts with special
    strings, and with code points that are not assigned yet (two libraries may class them by other versions of the
    standard), are encoded whole by the tokenizer."""

    #: fixed: the splitting pattern of the byte-level tokenizers
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, tokenizer, remember: int = 400_000):
        import regex
        self.tokenizer, self.remember = tokenizer, remember
        self.split = regex.compile(self.PATTERN).findall
        self.special = [a.content for a in tokenizer.get_added_tokens_decoder().values()]
        self.sure: set[str] = set()          # code points that are assigned
        self.known: dict[str, int] = {}      # tokens of a word; negative: its texts are not split here

    def _learn(self, new: list[str]) -> None:
        fresh = set().union(*new) - self.sure
        unsure = {c for c in fresh if category(c) == "Cn"}
        self.sure |= fresh - unsure
        for k, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[k] = len(e)
        for k in new if unsure else []:
            if not unsure.isdisjoint(k):
                self.known[k] = _NEVER

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > self.remember:  # keep those learnt first, which hold the frequent ones
            self.known = dict(islice(self.known.items(), self.remember // 2))
        words = [[] if any(s in x for s in self.special) else self.split(x) for x in texts]
        new = list(set().union(*words).difference(self.known))
        self._learn(new)
        out = [sum(map(self.known.__getitem__, w)) for w in words]
        whole = [k for k, (x, w) in enumerate(zip(texts, words, strict=True)) if x and not w or out[k] < 0]
        for k, e in zip(whole, self.tokenizer.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False), strict=True):
            out[k] = len(e)
        for k in new:
            if len(k) > _LONG_WORD:  # not worth its memory
                del self.known[k]
        return out


def _cut(docs: DataFrame, path: str, chunk: int, overlap: int, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, n_bytes, n_tokens`` of short texts; of longer ones a row per piece with ``piece, first, text``."""
    kind = "row long, doc_id long, n_bytes long, n_tokens long, piece long, first long, text string"

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        t = load(path)
        sure = margin(t) is not None
        words = WordCounts(t) if sure else None
        types = [pa.int64()] * 6 + [pa.string()]
        names = ["row", "doc_id", "n_bytes", "n_tokens", "piece", "first", "text"]
        for b in sliced(batches, 1 << 20):
            texts = [x or "" for x in b.column(1).to_pylist()]
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            short = [k for k, x in enumerate(texts) if len(x) <= chunk or not sure]
            own = [texts[k] for k in short]
            counts = words.count(own) if sure else [len(e) for e in t.encode_batch_fast(own, add_special_tokens=False)]
            count = dict(zip(short, counts, strict=True))
            out = []
            for k, (doc, row) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if k in count:
                    out.append((row, doc, size[k], count[k], None, None, None))
                else:
                    x = texts[k]
                    out += [(row, doc, size[k], None, i, at, x[at:at + chunk + overlap])
                            for i, at in enumerate(range(0, max(1, len(x) - overlap), chunk))]
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), types, strict=True)], names=names)
            del texts, own, out
        del t, words
        forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.monotonically_increasing_id().alias("row")).mapInArrow(run, kind)


def _encoded(pieces: DataFrame, path: str, overlap: int) -> DataFrame:
    """Per piece its tokens, and the word starts (with the tokens before them) in both its overlaps; those in the
    right one only as far as they are sure."""
    places = "array<long>"
    kind = f"row long, piece long, last long, tokens long, head {places}, head_k {places}, tail {places}, tail_k {places}"

    def run(batches):
        import pyarrow as pa
        from tokenizers import processors
        t = load(path)
        sure = margin(t)
        t.post_processor = processors.ByteLevel(trim_offsets=False)  # changes offsets only
        types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 4
        names = ["row", "piece", "last", "tokens", "head", "head_k", "tail", "tail_k"]
        for b in sliced(batches, 1 << 20, column=4):
            out = []
            for row, piece, last, first, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                e = t.encode(text, add_special_tokens=False)
                word = np.array(e.word_ids, np.int64)
                k = np.flatnonzero(np.diff(word, prepend=-1))
                offsets = e.offsets
                at = np.array([offsets[i][0] for i in k.tolist()], np.int64)
                head, tail = at <= overlap, (at >= len(text) - overlap) & (at <= len(text) - sure)
                out.append((row, piece, last, len(word), at[head] + first, k[head], at[tail] + first, k[tail]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), y) for c, y in zip(zip(*out, strict=True), types, strict=True)], names=names)
        del t
        forget()

    return pieces.select("row", "piece", "last", "first", "text").repartition("row", "piece").mapInArrow(run, kind)


def _spliced(encoded: DataFrame) -> DataFrame:
    """``row, piece, tokens, ends, delta``: whether the piece is its text's last, and of the splice to the next one
    the tokens before the first common word start, left less right; null if they have none."""
    right = encoded.select("row", (F.col("piece") - 1).alias("last"), F.col("head").alias("r"), F.col("head_k").alias("r_k"))
    both = encoded.join(right, ["row", "last"], "left").withColumn("place", F.array_min(F.array_intersect("tail", "r")))

    def before(k: str, at: str):
        return F.get(k, (F.array_position(at, F.col("place")) - 1).cast("int"))

    return both.select("row", "piece", "tokens", F.col("r").isNull().alias("ends"),
                       F.when(F.col("place").isNotNull(), before("tail_k", "tail") - before("r_k", "r")).alias("delta"))


def _widened(pieces: DataFrame, seams: DataFrame, overlap: int) -> DataFrame:
    """Neighbours without a common word start as one piece each: ``row, piece, last, first, text``."""
    order = Window.partitionBy("row").orderBy("piece")  # numbers only; the pieces of one text
    fails = ~F.col("ends") & F.col("delta").isNull()
    runs = seams.withColumn("joined", F.coalesce(F.lag(fails).over(order), F.lit(False))) \
        .withColumn("group", F.sum((~F.col("joined")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))) \
        .where(F.col("joined") | fails).select("row", "piece", "group")
    part = F.struct("piece", "text")
    return pieces.join(runs, ["row", "piece"]).groupBy("row", "group").agg(
        F.min("piece").alias("piece"), F.max("last").alias("last"), F.min("first").alias("first"),
        F.sort_array(F.collect_list(part)).alias("parts")).select(
        "row", "piece", "last", "first", F.concat(
            F.col("parts")[0]["text"],
            F.array_join(F.transform(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))),
                                     lambda p: F.substring(p["text"], overlap + 1, 2147483647)), "")).alias("text"))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document; ``chunk`` must be above ``overlap``."""
    if not 0 < overlap < chunk:
        raise ValueError("pieces must be longer than their overlap")
    cut = stored(_cut(docs, tokenizer_path, chunk, overlap, id_col, text_col), "tokens-cut")
    pieces = cut.where("piece is not null").select("row", "piece", F.col("piece").alias("last"), "first", "text")
    counts = cut.where("piece is null").select("row", "doc_id", "n_bytes", "n_tokens")
    if not pieces.isEmpty():
        encoded = stored(_encoded(pieces, tokenizer_path, overlap), "tokens-encoded")
        while True:
            seams = stored(_spliced(encoded), "tokens-seams")
            if seams.where("not ends and delta is null").isEmpty():
                break
            wide = stored(_widened(pieces, seams, overlap), "tokens-widened")
            # pieces inside a widened one go
            spans = wide.select("row", F.explode(F.sequence("piece", "last")).alias("piece"))
            pieces = pieces.join(spans, ["row", "piece"], "left_anti").unionByName(wide)
            encoded = stored(encoded.join(spans, ["row", "piece"], "left_anti")
                             .unionByName(_encoded(wide, tokenizer_path, overlap)), "tokens-encoded")
        long = seams.groupBy("row").agg(F.sum(F.when(F.col("ends"), F.col("tokens")).otherwise(F.col("delta"))).alias("n_tokens"))
        named = cut.where("piece = 0").select("row", "doc_id", "n_bytes")
        counts = counts.unionByName(named.join(long, "row").select("row", "doc_id", "n_bytes", "n_tokens"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
