"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text recognises every substring of that text. A document
is parsed greedily: from each place the longest substring known to the automaton is one phrase. The language
that needs the fewest phrases, normalised by length and by the size of its labelled text
(``phrases * log2(labelled characters) / characters``), wins; ties go to the first name in sorted order. A letter
that a language's sample does not have must be spelled out: it costs ``log2(letters of all samples)`` more, else the
language with the smallest sample would win any text that few samples know.

The classifier is fitted on a bounded sample: ``docs_per_lang`` labelled texts per language, ``chars_per_doc``
characters of each, for every label (a model holds about 2 to 10 MB a label with a full sample). Prediction reads whole texts: they are parsed in blocks of ``block`` characters (a phrase
ends at a block's end), all blocks of a batch in lockstep over one transition table, so a long text costs no
more than short ones. Letters are lower-cased, every run of other characters is one blank. Each language knows every
letter of its own sample, whatever the script.

``und`` with score 0 for a text that is null or has no letter, and for every text when nothing is labelled.
``score`` is ``1 - best / second best`` (1 when only one language is known). Repeated rows get equal rows;
other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aeris.llm.common import forget, sliced

DOCS_PER_LANG = 96
CHARS_PER_DOC = 320
SHORT = 40
DENSE_BYTES = 96 << 20
BLOCK = 256
UNKNOWN = "und"


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  docs_per_lang: int = DOCS_PER_LANG, chars_per_doc: int = CHARS_PER_DOC) -> DataFrame:
    """At most ``docs_per_lang`` labelled texts per language, those with the smallest hashes of id and text. Texts
    under ``SHORT`` characters are taken only where a language has too few longer ones; equal rows are one.

    Different rows are counted first, by label and by short or long; a hash threshold then leaves a few times the
    wanted rows of each before any text is ranked, so that no language's rows meet in one task. Every label with a
    text that holds a letter is learned."""
    id_, text = F.col(id_col).cast("string"), F.col(text_col)
    rows = docs.where(F.col(lang_col).isNotNull() & (F.crc32(F.coalesce(id_, F.lit(""))) % 4 != 2) & text.rlike(r"\p{L}")) \
        .select(F.col(lang_col).alias("lang"), (F.length(text) < SHORT).alias("short"),
                (F.xxhash64(id_, text) / F.lit(2.0 ** 64) + F.lit(0.5)).alias("part"),
                F.substring(F.regexp_replace(text, r"^\P{L}+", ""), 1, chars_per_doc).alias("text"))
    different = rows.groupBy(F.col("lang").alias("lang_"), F.col("short").alias("short_")) \
        .agg(F.approx_count_distinct("part").alias("n_"), F.min("part").alias("least_"))
    enough = different.where(~F.col("short_") & (F.col("n_") >= 2 * docs_per_lang)).select("lang_")
    sizes = different.where(~F.col("short_")).unionByName(different.where("short_").join(enough, "lang_", "left_anti"))
    few = rows.join(F.broadcast(sizes), (rows.lang == sizes["lang_"]) & (rows.short == sizes["short_"])) \
        .where(F.col("part") <= F.greatest(F.lit(6.0 * docs_per_lang) / F.col("n_"), F.col("least_"))) \
        .select("lang", "short", "part", "text").distinct()
    order = Window.partitionBy("lang").orderBy("short", "part", "text")
    return few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_per_lang).select("lang", "part", "text")


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


_IS_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _IS_LETTER:
        _IS_LETTER.append(_letters())
    return _IS_LETTER[0]


def normal(text: str) -> np.ndarray:
    """Code points of the lower-cased letters of ``text``, runs of anything else as one blank (32)."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    alpha = letters()[cps]
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]
    return np.where(alpha, cps, 32)[keep]


class Automaton:
    """Suffix automaton over small integer symbols, as plain lists of transitions."""

    def __init__(self):
        self.next, self.link, self.len = [{}], [-1], [0]
        self.last = 0

    def feed(self, symbol: int) -> None:
        cur = self._state({}, 0, self.len[self.last] + 1)
        p = self.last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            if self.len[q] != self.len[p] + 1:
                copy = self._state(dict(self.next[q]), self.link[q], self.len[p] + 1)
                while p >= 0 and self.next[p].get(symbol) == q:
                    self.next[p][symbol] = copy
                    p = self.link[p]
                self.link[q] = copy
                q = copy
            self.link[cur] = q
        self.last = cur

    def _state(self, moves, link, length) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        return len(self.next) - 1


class Table:
    """Steps of one automaton by a table over all states and symbols."""

    def __init__(self, width: int, states: int, state: np.ndarray, symbol: np.ndarray, to: np.ndarray):
        self.kind = np.int32 if 4 * width * states < 2 ** 31 else np.int64
        table = np.empty((states, width), self.kind)
        table[:] = _leave(width, state, symbol, to)
        table[0] = 1
        table[state, symbol] = 4 * width * to
        self.table = table.ravel()

    def of(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.table.take(state + symbol)


class Keys:
    """The same steps by a search among the transitions there are."""

    kind = np.int64

    def __init__(self, width: int, states: int, state: np.ndarray, symbol: np.ndarray, to: np.ndarray):
        key = state * width + symbol
        order = np.argsort(key)
        self.keys = np.append(key[order], np.iinfo(np.int64).max)
        self.to = np.append(to[order] * (4 * width), 0)
        self.leave = _leave(width, state, symbol, to)

    def of(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = self.leave.take(symbol)
        out -= (symbol == 0) & (state == 0)
        known = np.flatnonzero(symbol)
        key = state[known] + symbol[known]
        at = self.keys.searchsorted(key)
        stays = self.keys.take(at) == key
        out[known[stays]] = self.to.take(at[stays])
        return out


def _leave(width: int, state: np.ndarray, symbol: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Steps that close the open phrase, by symbol; the unknown symbol closes its own as well."""
    out = np.full(width, 2, np.int64)
    out[symbol[state == 0]] = 4 * width * to[state == 0] + 1
    return out


class Model:
    """Transitions of every language's automaton over the symbols of its own sample.

    A step gives ``4 * (next state * width) + phrases closed by this step``. A step that leaves the automaton closes a
    phrase and starts the next one with the same symbol; a symbol the language does not know (0) is a phrase of its
    own. Automata are tables indexed by ``state * width + symbol`` as long as all of them take at most ``dense_bytes``,
    those with the smallest tables first; the others (large alphabets, many languages) are sorted keys. Both give the
    same steps."""

    def __init__(self, samples: dict[str, list[str]], dense_bytes: int = DENSE_BYTES):
        texts = {g: [normal(" " + t + " ") for t in samples[g]] for g in samples}
        self.langs = sorted(g for g in texts if any(map(len, texts[g])))
        seen = np.unique(np.concatenate([np.zeros(0, np.uint32), *(t for g in self.langs for t in texts[g])]))
        kind = np.uint16 if len(seen) < 2 ** 16 - 1 else np.uint32
        self.symbols = np.zeros(sys.maxunicode + 1, kind)  # 0: in no sample
        self.symbols[seen] = np.arange(1, len(seen) + 1)
        self.spelling = float(np.log2(max(2, len(seen))))
        self.own, self.scale, self.steps, moves = [], [], [], []
        for g in self.langs:
            coded = [self.symbols[t] for t in texts[g]]
            letters_ = np.unique(np.concatenate([np.zeros(0, kind), *coded]))
            own = np.zeros(len(seen) + 1, kind)  # the language's symbols, from all languages' symbols
            own[letters_] = np.arange(1, len(letters_) + 1)
            auto = Automaton()
            for t in coded:  # one after the other: the few substrings across texts do no harm
                for s in own[t].tolist():
                    auto.feed(s)
            n = sum(map(len, auto.next))
            state = np.repeat(np.arange(len(auto.next)), [len(m) for m in auto.next])
            moves.append((len(letters_) + 1, len(auto.next), state, np.fromiter((s for m in auto.next for s in m), np.int64, n),
                          np.fromiter((to for m in auto.next for to in m.values()), np.int64, n)))
            self.own.append(own)
            self.scale.append(float(np.log2(max(2, sum(map(len, coded))))))
        sizes = [width * states * (4 if 4 * width * states < 2 ** 31 else 8) for width, states, *_ in moves]
        dense, total = set(), 0
        for j in sorted(range(len(sizes)), key=lambda j: (sizes[j], j)):
            total += sizes[j]
            if total <= dense_bytes:
                dense.add(j)
        self.steps = [(Table if j in dense else Keys)(*m) for j, m in enumerate(moves)]

    def rates(self, texts: list[str | None], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases per language (rows: texts), and whether a text has letters."""
        rate, _, has = self._parsed(texts, block)
        return rate, has

    def _parsed(self, texts: list[str | None], block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised phrases and share of unknown letters per language, and whether a text has letters."""
        n, k = len(texts), len(self.langs)
        coded = [np.zeros(0, np.uint32) if not t else normal(t) for t in texts]
        has = np.array([bool((c != 32).any()) for c in coded], bool)
        total, missing, size = np.zeros((n, k)), np.zeros((n, k)), np.array([max(1, len(c)) for c in coded], float)
        if k == 0:
            return total, missing, has
        pieces = np.array([-(-len(c) // block) for c in coded])
        owner = np.repeat(np.arange(n), pieces)
        grid = np.zeros((len(owner), block), self.symbols.dtype)
        length = np.zeros(len(owner), np.int64)
        row = 0
        for c, p in zip(coded, pieces, strict=True):
            if p:
                flat = grid[row:row + p].reshape(-1)
                flat[:len(c)] = self.symbols[c]
                length[row:row + p] = block
                length[row + p - 1] = len(c) - (p - 1) * block
                row += p
        order = np.argsort(-length, kind="stable")  # those still running are a prefix
        step = 4096
        for at in range(0, len(order), step):
            rows = order[at:at + step]
            sub, lens = np.ascontiguousarray(grid[rows].T), length[rows]
            running = np.searchsorted(-lens, -np.arange(block), side="left")  # rows with length > i
            for j, steps in enumerate(self.steps):
                own = self.own[j].astype(steps.kind).take(sub[:int(lens[0])])
                state = np.zeros(len(rows), steps.kind)
                phrases = np.zeros(len(rows), np.int64)
                for i in range(int(lens[0])):
                    m = running[i]
                    v = steps.of(state[:m], own[i, :m])
                    phrases[:m] += v & 3
                    state[:m] = v >> 2
                phrases += state != 0
                np.add.at(total[:, j], owner[rows], phrases)
                np.add.at(missing[:, j], owner[rows], lens - np.count_nonzero(own, axis=0))
        return total * np.array(self.scale) / size[:, None], missing / size[:, None], has

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        rate, missing, has = self._parsed(texts, BLOCK)
        rate = rate + missing * self.spelling
        names, scores = [], []
        for r, ok in zip(rate, has, strict=True):
            if not ok or not len(r):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(np.argmin(r))
            second = float(np.min(np.delete(r, best))) if len(r) > 1 else 0.0
            names.append(self.langs[best])
            scores.append(1.0 if len(r) == 1 else max(0.0, 1.0 - float(r[best]) / second) if second else 0.0)
        return names, scores


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        docs_per_lang: int = DOCS_PER_LANG, chars_per_doc: int = CHARS_PER_DOC) -> Model:
    """The model of the sample of labelled rows; the sample (bounded by its parameters) comes to the driver."""
    samples: dict[str, list[str]] = {}
    rows = training_rows(docs, id_col, text_col, lang_col, docs_per_lang, chars_per_doc).collect()
    for r in sorted(rows, key=lambda r: (r.lang, r.part, r.text)):
        samples.setdefault(r.lang, []).append(r.text)
    return Model(samples)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; the model (a few MB per language) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in sliced(batches, 4 << 20):
            names, scores = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])
        forget()

    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return two.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: ``crc32(id as text) mod 4 = 2``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold and predict every row."""
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language cannot be told (``und``), all columns as they were. Where
    nothing is labelled no language can be ruled out, and only texts without a letter go."""
    model = fit(docs, id_col, text_col) if "lang" in docs.columns else Model({})
    shared = docs.sparkSession.sparkContext.broadcast(model if model.langs else Model({"any": ["a"]}))

    @F.arrow_udf("boolean")
    def known(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            out: list[bool] = []
            for at in range(0, len(texts), 256):
                names, _ = shared.value.predict(texts[at:at + 256].to_pylist())
                out += [x != UNKNOWN for x in names]
            yield pa.array(out, pa.bool_())
        forget()

    return docs.where(known(F.col(text_col)))
