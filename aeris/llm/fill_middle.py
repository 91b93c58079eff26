"""Fill-in-the-middle transformation of documents.

A text is a row of units: white space (blank, tab to carriage return) and the run of other characters behind it, or
white space at the end. One ``fullmatch`` of ``(unit)*`` by the ``regex`` library, which keeps every repetition of a
group, gives the ends of all units: their number n, and the two cuts by indexing. Two hash numbers modulo n + 1 say
after how many units the prefix and the middle end. Texts above ``_PIECE`` code points are matched in pieces that end
where a unit ends, since a match holds its captures in memory; the ends are those of the whole text.

Four numbers h1 to h4 are the first 8-digit groups of the hexadecimal SHA-256 of ``seed:id``. A document stays
``plain`` if its text is empty or holds one of the markers, or if h3 % 100 >= ``rate``; otherwise it is ``spm``
(suffix first) if h4 % 100 < ``spm``, else ``psm``.

Null texts are empty; a null id counts as the empty string in the hash. Repeated rows give repeated, equal rows; rows
with the same id and other texts are cut each by its own n. Other columns are ignored, an empty table gives an empty
result. Memory per task: one batch of texts (16 MB, or one longer text), its outputs, 8 bytes per unit of one text and
the captures of one piece.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeris.llm.common import forget, sliced

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_PIECE = 1 << 20
_WHITE = r"[\x20\x09-\x0D]"
_OTHER = r"[^\x20\x09-\x0D]"


def units() -> tuple:
    """The pattern ``(unit)*`` and the pattern of a place where a unit ends before white space."""
    import regex
    return (regex.compile(f"({_WHITE}*+{_OTHER}++|{_WHITE}++)*+"), regex.compile(f"{_OTHER}(?={_WHITE})"))


def unit_ends(text: str, patterns: tuple, piece: int = _PIECE) -> np.ndarray:
    """Ends of all units of ``text``, in code points."""
    whole, seam = patterns
    if len(text) <= piece:
        return np.array(whole.fullmatch(text).ends(1), np.int64)
    out, at = [], 0
    while at < len(text):
        cut = seam.search(text, min(at + piece, len(text)) - 1)
        upto = cut.end() if cut else len(text)
        out.append(np.array(whole.fullmatch(text, at, upto).ends(1), np.int64))
        at = upto
    return np.concatenate(out)


def _numbers(seed: int, doc: int | None) -> list[int]:
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document."""
    kind = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def one(doc: int | None, text: str, patterns: tuple) -> tuple:
        ends = unit_ends(text, patterns)
        h1, h2, h3, h4 = _numbers(seed, doc)
        n = len(ends)
        if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            return doc, n, "plain", None, None, text
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (int(ends[k - 1]) if k else 0 for k in (first, second))
        head, middle, tail = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm:
            return doc, n, "spm", a, b - a, "".join((SUFFIX, tail, PREFIX, head, MIDDLE, middle))
        return doc, n, "psm", a, b - a, "".join((PREFIX, head, SUFFIX, tail, MIDDLE, middle))

    def run(batches):
        import pyarrow as pa
        patterns = units()
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        for b in sliced(batches):
            out = [one(d, t or "", patterns) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)],
                                             names=names)
            del out
        forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kind)


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from its output and form alone: a text with a marker is always plain, and no marker can
    arise across a seam (each ends with ``>`` and begins with ``<``), so the markers found are the ones put in."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])) \
        .otherwise(F.concat(part[2], part[3], part[1]))
