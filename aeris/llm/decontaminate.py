"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Texts become template words: numbers, names (capitalised words inside a sentence) and units are replaced by
typed placeholders, everything else is lower-cased. Hashes of ``WINDOW`` consecutive template words of the
documents are joined with those of the benchmark items, so that a question asked again with other numbers or
names still meets its item. Each match is then checked for slot consistency: within one document and item, a
value of the item must always stand for the same value of the document, else the match goes.

Every window also has a second key, the hash of its lower-cased words as they stand, so that a word-for-word copy is
met whatever its words are (numbers, names) and whatever its case, line breaks or the words before it.

An item is found in a document when consistent windows cover ``MIN_COVER`` of its template words or at least
``MIN_RUN`` of them. Windows with fewer than ``MIN_LITERAL`` literal words are evidence word for word only. Items
shorter than a window are one window of all their words, by the same rule; very short ones (one word) are thus found
in every document with these words. A match goes when its template windows are inconsistent, copied words or not.

Null and empty texts match nothing; repeated rows of either table are matched alike; other columns are ignored
or kept as they are; an empty table on either side gives no match. Rows with a null id cannot be reported and
are never removed. All windows of all documents are tested. Benchmarks of at most ``BROADCAST_WINDOWS`` windows
(counted) are broadcast; larger ones meet the documents by a shuffle join. So are the ids of documents with matches,
up to ``BROADCAST_IDS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeris.llm.common import fresh, stored

WINDOW = 8
MIN_LITERAL = 4
MIN_COVER = 0.5
MIN_RUN = 13
BROADCAST_WINDOWS = 2_000_000
BROADCAST_IDS = 2_000_000

# Unit words that follow a number.
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound "
         "pounds ounce ounces ml l liter liters litre litres second seconds minute minutes hour hours day days week weeks "
         "month months year years dollar dollars euro euros cent cents percent degree degrees kmh mph").split()

# A name: a capitalised word after a word or comma and white space, hence not at the start of a sentence.
# The expression matches the white space before it, whatever and however much that is.
_NAME = r"(?=[\s\p{Z}])(?<=[\p{L}\p{N},;])[\s\p{Z}]+(?=\p{Lu}[\p{Ll}'’-]+(?:$|[^\p{L}\p{N}]))"
_MARK = "\u0001"  # stands before a name while the text is one string
_NUMBER = "#n"
_UNIT = "#u"
_PERSON = "#p"


def words(text: Column) -> Column:
    """Lower-cased words of a text in order, names marked."""
    marked = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), _NAME, "$0" + _MARK))
    return F.array_remove(F.split(marked, rf"[^\p{{L}}\p{{N}}{_MARK}]+"), "")


def canonical(w: Column) -> Column:
    """Template word of a word: a typed placeholder, or the word. Marked names sort before digits, and digits
    before letters."""
    return F.when(w < "\u0002", F.lit(_PERSON)).when(w < ":", F.lit(_NUMBER)).when(w.isin(*UNITS), F.lit(_UNIT)).otherwise(w)


def bare(w: Column) -> Column:
    """The word without the mark of a name."""
    return F.when(w < "\u0002", F.substring(w, 2, 1 << 30)).otherwise(w)


def template(raw: Column) -> Column:
    return F.transform(raw, canonical)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def window_hashes(raw: Column) -> Column:
    """64-bit hashes of all windows of eight template words."""
    return _doubled(F.transform(raw, lambda w: F.xxhash64(canonical(w))))


def copy_hashes(raw: Column) -> Column:
    """64-bit hashes of all windows of eight words as they stand."""
    return _doubled(F.transform(raw, lambda w: F.xxhash64(bare(w), F.lit("copy"))))


def _doubled(one: Column) -> Column:
    """By doubling: hashes of one, two, four, eight words."""
    return _let(_let(_let(one, lambda h: _paired(h, 1)), lambda h: _paired(h, 2)), lambda h: _paired(h, 4))


def _paired(h: Column, gap: int) -> Column:
    """Hashes of ``h[i], h[i + gap]`` for every i that has both."""
    n = F.greatest(F.size(h) - gap, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(gap + 1), n), lambda a, b: F.xxhash64(a, b))


def _short(tokens: Column) -> Column:
    return F.xxhash64(F.concat_ws(" ", tokens), F.lit("short"))


def _short_copy(words_: Column) -> Column:
    return F.xxhash64(F.concat_ws(" ", F.transform(words_, bare)), F.lit("short copy"))


def _is_slot(w: Column) -> Column:
    return w.isin(_NUMBER, _UNIT, _PERSON)


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(h, item, at, n, size, raw, t, copy)``: every window of every item, with the words it stands for, by its
    words (``copy``) and, where it has enough literal ones, by its template words; an item shorter than a window is
    one window of its ``size`` words."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item"), words(F.col(text_col)).alias("raw"))
    items = stored(items.withColumn("t", template(F.col("raw"))).where(F.size("raw") > 0), "bench-items")
    piece = lambda c: F.slice(c, F.col("at") + 1, F.col("size"))
    enough = F.size(F.filter("t", lambda w: ~_is_slot(w))) >= MIN_LITERAL

    def windows(hashes, short, copy: bool) -> DataFrame:
        long = items.where(F.size("t") >= WINDOW).select(
            "item", "raw", "t", F.posexplode(hashes).alias("at", "h"), F.lit(WINDOW).alias("size"))
        few = items.where(F.size("t") < WINDOW).select(
            "item", "raw", "t", F.lit(0).alias("at"), short.alias("h"), F.size("t").alias("size"))
        both = long.unionByName(few).withColumn("n", F.size("t")) \
            .withColumn("t", piece(F.col("t"))).withColumn("raw", piece(F.col("raw"))).withColumn("copy", F.lit(copy))
        return both if copy else both.where(enough)

    return windows(window_hashes(F.col("raw")), _short(F.col("t")), False) \
        .unionByName(windows(copy_hashes(F.col("raw")), _short_copy(F.col("raw")), True)) \
        .select("h", "item", "at", "n", "size", "raw", "t", "copy").dropDuplicates(["h", "item", "at", "copy"])


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, tk, pos, h)``: places in documents where some item's window stands; ``tk`` tells the texts of one id apart."""
    n, lengths = windows.agg(F.count(F.lit(1)), F.collect_set(F.when(F.col("size") < WINDOW, F.col("size")))).first()
    keys = windows.select("h").distinct()
    keys = F.broadcast(keys) if n <= BROADCAST_WINDOWS else keys
    tokens = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), _text_key(F.col(text_col)).alias("tk"), words(F.col(text_col)).alias("raw"))

    def met(size: int, by_template: Column, by_copy: Column) -> DataFrame:
        """Both hashes of every place of ``size`` words, one list after the other."""
        counted = tokens.select("doc", "tk", "raw", (F.size("raw") - (size - 1)).alias("places"))  # not the words beside every place
        return counted.select("doc", "tk", "places", F.posexplode(F.concat(by_template, by_copy)).alias("i", "h")) \
            .join(keys, "h", "left_semi").select("doc", "tk", (F.col("i") % F.col("places")).alias("pos"), "h")

    found = met(WINDOW, window_hashes(F.col("raw")), copy_hashes(F.col("raw")))
    for size in sorted(lengths):  # items shorter than a window: at most a few lengths
        starts = F.when(F.size("raw") >= size, F.sequence(F.lit(0), F.size("raw") - size)).otherwise(F.array().cast("array<int>"))
        places = lambda all_, of: _let(all_, lambda t: F.transform(starts, lambda at: of(F.slice(t, at + 1, F.lit(size)))))  # noqa: E731, B023
        found = found.unionByName(met(size, places(template(F.col("raw")), _short), places(F.col("raw"), _short_copy)))
    return found


def _sized(ids: DataFrame) -> DataFrame:
    """Ids marked for a broadcast when they are few (counted); else the texts meet them in a shuffle."""
    ids = stored(ids, "bench-ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", min_cover: float = MIN_COVER,
            min_run: int = MIN_RUN) -> DataFrame:
    """``doc_id, item_id, n_words, covered, n_slots, n_changed``: items found in documents, with the item's template
    words covered by consistent windows, the slots checked and those with another value than in the item. Of texts that
    share an id the one with most covered words tells (then most changed slots, most slots)."""
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, min_cover, min_run)
    best = found.groupBy("doc", "item").agg(F.max(F.struct("covered", "changed", "slots", "n")).alias("m"))
    return best.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("m.n").alias("n_words"),
                       F.col("m.covered").alias("covered"), F.col("m.slots").alias("n_slots"), F.col("m.changed").alias("n_changed"))


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id",
           item_text_col: str = "text", min_cover: float = MIN_COVER, min_run: int = MIN_RUN) -> DataFrame:
    """``doc, tk, item, n, covered, slots, changed``: items found in texts, each text by itself."""
    windows = stored(item_windows(benchmark, item_col, item_text_col), "bench-windows")
    found = stored(hits(docs, windows, id_col, text_col), "bench-hits")
    # the words of the texts that were hit, at the places that were hit
    ids = _sized(found.select("doc", "tk").distinct())
    raw = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), _text_key(F.col(text_col)).alias("tk"), F.col(text_col).alias("text")) \
        .join(ids, ["doc", "tk"], "left_semi").select("doc", "tk", words(F.col("text")).alias("dw"))
    # one row per text with its places: places are bounded by its words
    places = found.groupBy("doc", "tk").agg(F.collect_set(F.struct("pos", "h")).alias("places"))
    at = raw.join(places, ["doc", "tk"]).select("doc", "tk", "dw", F.explode("places").alias("x")) \
        .select("doc", "tk", F.col("x.h").alias("h"), F.col("x.pos").alias("pos"), F.slice("dw", F.col("x.pos") + 1, WINDOW).alias("dw"))
    pairs = stored(at.join(windows.withColumnRenamed("raw", "bw"), "h").withColumn("dw", F.slice("dw", F.lit(1), F.col("size"))),
                   "bench-pairs")
    # slots: what the item's value stands for in the text; item and text positions agree by their difference
    slot = F.explode(F.filter(F.arrays_zip("t", "bw", "dw"), lambda x: _is_slot(x["t"]))).alias("s")
    place = F.col("pos") - F.col("at")
    one = ["doc", "tk", "item", "place"]
    slots = pairs.select("doc", "tk", "item", place.alias("place"), "copy", slot).select(
        *one, "copy", bare(F.lower("s.bw")).alias("was"),
        F.when(~F.col("copy"), bare(F.lower("s.dw"))).alias("now")).distinct()
    values = slots.groupBy(*one, "was").agg(  # none: the value stands in copied windows only
        F.min("now").alias("lo"), F.max("now").alias("hi"))
    bad = values.groupBy(*one).agg(
        F.max(F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).cast("int")).alias("bad"), F.count(F.lit(1)).alias("slots"),
        F.sum(F.coalesce(F.col("was") != F.col("lo"), F.lit(False)).cast("long")).alias("changed"))
    per_place = pairs.select("doc", "tk", "item", place.alias("place"), "n", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("w")) \
        .groupBy(*one).agg(F.max("n").alias("n"), F.collect_set("w").alias("ws"))
    good = per_place.join(bad, one, "left").where(F.coalesce("bad", F.lit(0)) == 0)
    whole = good.groupBy("doc", "tk", "item").agg(
        F.max("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("ws")))).alias("covered"),
        F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"))
    enough = (F.col("covered") >= F.lit(min_run)) | (F.col("covered") >= F.col("n") * F.lit(min_cover))
    return whole.where(enough)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item was found, all columns as they were."""
    key, text_key = fresh(docs, "_leak_id", "_leak_text")
    found = _found(docs, benchmark, id_col, text_col).select(F.col("doc").alias(key), F.col("tk").alias(text_key)).distinct()
    return docs.join(_sized(found), (F.col(id_col).cast("long") == F.col(key)) & (_text_key(F.col(text_col)) == F.col(text_key)),
                     "left_anti")
