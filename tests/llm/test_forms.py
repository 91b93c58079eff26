"""Fill-in-the-middle, token counts and the prefix trie against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aeris.llm import fill_middle, prefix_trie, queries, token_count
from aeris.llm.common import read_table, ship

DOC = "doc_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- 11: fill-in-the-middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(doc, text, seed=42, rate=50, spm=80):
    text = text or ""
    u = UNIT.findall(text)
    assert "".join(u) == text
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(u)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc, n, "plain", None, None, text
    if h4 % 100 < spm:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows():
    rng = random.Random(11)
    pieces = ["a", "bc ", "  ", "\t", "\n\n", "é", "漢字", " ", " ", "\x1c", "<", "<P", "<S", "S>", ">", "😀 ", "x\r\n", "\x0b", "\x00"]
    out = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    return out + [(1000, None), (1001, ""), (1002, " \n"), (1003, "with <P> inside"), (1004, "<M>"), (7, "same id"), (7, "same id"),
                  (None, "no id " * 5), (1005, "x" * 4000), (1006, " " * 4000 + "y"), (-3, "negative id is an id")]


def test_fill_middle(spark):
    data = fim_rows()
    extra = [(d, t, "z", 1) for d, t in data]
    df = spark.createDataFrame(extra, DOC + ", output string, form_ long").repartition(3)
    got = fill_middle.transform(df, rate=80, spm=50)
    expected = sorted((brute_fim(d, t, rate=80, spm=50) for d, t in data), key=repr)
    assert rows(got) == expected
    assert {"plain", "psm", "spm"} == {e[2] for e in expected}
    back = got.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert rows(back) == sorted(((d, t or "") for d, t in data), key=repr)
    assert fill_middle.transform(df.limit(0)).count() == 0


def test_fill_middle_long_texts_in_pieces():
    patterns = fill_middle.units()
    rng = random.Random(3)
    for text in (*(t or "" for _, t in fim_rows()), "x" * 999, " " * 999, "ab  cd" * 300,
                 "".join(rng.choice(" \nab") for _ in range(3000))):
        whole = fill_middle.unit_ends(text, patterns).tolist()
        assert whole == [m.end() for m in UNIT.finditer(text)]
        for piece in (1, 2, 7, 100):
            assert fill_middle.unit_ends(text, patterns, piece).tolist() == whole


def test_fill_middle_query(spark, sf_small):
    docs = read_table(spark, sf_small, "documents").select("doc_id", "text").collect()
    expected = []
    for r in docs:
        *head, out = brute_fim(r.doc_id, r.text)
        expected.append((*head, sha(out), sha(r.text or "")))
    assert rows(queries.QUERIES["op11_fill_middle"](spark, sf_small)) == sorted(expected, key=repr)


# ---------------------------------------------------------------- 12: token counts

@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path("byte_bpe_50k.json")


def counted(tokenizer, data, limit=1024):
    out = []
    for d, t in data:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        out.append((d, len((t or "").encode()), n, n > limit))
    return sorted(out, key=repr)


def token_texts():
    rng = random.Random(12)
    bits = ["don't ", " we'll", "'re", "  ", "\n", "\n\n  ", "123", " 4567", "漢字", " über", "😀", "é", "<|endoftext|>", "<|endof", "text|>", "!!", " ...",
            "hello ", "world", "\t", " ", " the", "ab" * 20, "'", "' ", "<|"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 400))) for _ in range(60)]


def test_token_count(spark, path):
    tokenizer = token_count.load(path)
    data = list(enumerate(token_texts()))
    data += [(100, None), (101, ""), (102, " "), (3, data[3][1]), (3, "same id, other text"), (None, "no id"), (103, "a" * 3000), (104, " " * 3000),
             (105, "\n" * 700 + "x" + " " * 900 + "y"), (106, "word " * 700), (107, "<|endoftext|>" * 200), (108, "😀" * 700)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in data], DOC + ", n_tokens long, row string").repartition(3)
    expected = counted(tokenizer, data, limit=100)
    assert rows(token_count.count_tokens(df, path, limit=100)) == expected
    # small pieces, so that splices, failing ones too, are met everywhere
    for chunk, overlap in ((200, 60), (50, 40), (40, 16)):
        assert rows(token_count.count_tokens(df, path, limit=100, chunk=chunk, overlap=overlap)) == expected
    assert token_count.count_tokens(df.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        token_count.count_tokens(df, path, chunk=10, overlap=10)


def test_token_count_without_proof(spark):
    """A tokenizer with a normaliser and another splitter encodes whole texts."""
    other = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer = token_count.load(other)
    assert token_count.margin(tokenizer) is None and token_count.margin(token_count.load(queries.tokenizer_path("byte_bpe_50k.json"))) == 13
    data = [(0, "Some Words. " * 50), (1, None)]
    got = token_count.count_tokens(spark.createDataFrame(data, DOC), other, chunk=40, overlap=16)
    assert rows(got) == counted(tokenizer, data)


def test_token_count_query(spark, sf_small, path):
    docs = [(r.doc_id, r.text) for r in read_table(spark, sf_small, "documents").select("doc_id", "text").collect()]
    assert rows(queries.QUERIES["op12_token_count"](spark, sf_small)) == counted(token_count.load(path), docs)


@pytest.fixture(scope="module")
def tokenizer(path):
    return token_count.load(path)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["a", "'", "'r", "e", " ", "  ", "\n", "\t", "1", "é", "漢", "!", "<|endoftext|>", "<|endof", "text|>", "|", " ", "😀", "ll", " "]),
                max_size=60).map("".join), st.integers(0, 60))
def test_word_starts_are_sure(tokenizer, text, cut):
    """A word start of a cut text that is ``margin`` before the cut is one of the whole text, and a scan begun there
    goes on like the whole one."""
    def starts(t):
        e = tokenizer.encode(t, add_special_tokens=False)
        return {o[0]: k for k, (o, w) in enumerate(zip(e.offsets, e.word_ids)) if k == 0 or w != e.word_ids[k - 1]}, e.ids
    whole, ids = starts(text)
    part, part_ids = starts(text[:cut])
    sure = [p for p in part if p <= len(text[:cut]) - token_count.margin(tokenizer)]
    for p in sure:
        assert p in whole and part_ids[:part[p]] == ids[:whole[p]]
        assert tokenizer.encode(text[p:], add_special_tokens=False).ids == ids[whole[p]:]


# ---------------------------------------------------------------- 13: prefix trie

def rebuilt(data):
    own = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute_trie(data):
    convs = rebuilt(data)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not children[k]
        saved[k] += (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], sha(ends)))
    return sorted(out, key=repr)


LOG = "conv_id long, turn long, role string, text string"


def conversations(n, longest, seed, texts=3):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(n * 3), n):
        for t in range(rng.randint(1, longest)):
            out.append((c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", "bot"]), "t" * rng.randrange(texts)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n, longest, texts", [(120, 9, 2), (60, 40, 2), (300, 3, 4), (5, 1, 2)])
def test_prefix_trie(spark, n, longest, texts):
    data = conversations(n, longest, seed=n, texts=texts)
    data += [(None, 0, "user", "left out"), (9001, 0, None, None), (9001, 1, "user", "é漢😀")]
    # copies of one conversation, and one long one
    data += [(c, t, "user", f"copy {t}") for c in range(20000, 20040) for t in range(4)]
    data += [(30000, t, "bot", "x") for t in range(70)] + [(30001, t, "bot", "x") for t in range(55)]
    # repeated rows are turns of their own
    data += [(40000, 1, "user", "again")] * 3
    df = spark.createDataFrame([(*r, 0, "q") for r in data], LOG + ", depth long, x1 string").repartition(4)
    assert rows(prefix_trie.prefix_trie(df)) == brute_trie(data)


def test_prefix_trie_small_tables(spark):
    df = spark.createDataFrame([], LOG)
    assert prefix_trie.prefix_trie(df).count() == 0
    # one conversation whose opening is absent and shorter than what it would lend: no turns are left
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 3)
    for data in ([(c, 0, "user", "a"), (c, 1, "bot", "b")], [(c, 0, "u", "a")] * 9, [(100, None, None, None)], [(100, 0, "u", "a"), (c, 5, "u", "b")]):
        assert rows(prefix_trie.prefix_trie(spark.createDataFrame(data, LOG))) == brute_trie(data)


def test_prefix_trie_ties(spark):
    """Turns with one number stand in the order of their hashes, whatever the order of the rows."""
    data = [(200, 1, "user", x) for x in "abcdef"] + [(201, 1, "user", x) for x in "fedcba"]
    a = rows(prefix_trie.prefix_trie(spark.createDataFrame(data, LOG)))
    b = rows(prefix_trie.prefix_trie(spark.createDataFrame(data[::-1], LOG).repartition(3)))
    assert a == b and len(a) > 6


def test_member_digests_in_slices(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_SLICE", 3)
    ends = [(1, 1, c) for c in range(100)] + [(1, 2, 5)] + [(2, 0, c) for c in range(7, 0, -1)]
    got = rows(prefix_trie.digests(spark.createDataFrame(ends, "x1 long, x2 long, conv long").repartition(5)))
    assert got == sorted([(1, 1, sha(",".join(map(str, range(100))))), (1, 2, sha("5")), (2, 0, sha("1,2,3,4,5,6,7"))], key=repr)


def test_prefix_trie_query(spark, sf_small):
    log = [tuple(r) for r in read_table(spark, sf_small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows(queries.QUERIES["op13_prefix_trie"](spark, sf_small)) == brute_trie(log)


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["don't", " ", "\n ", "<|endoftext|>", "١٢", "漢", "\x1c", "\x85", "՘", "\U000323b0x", "ǅ", "²", "é"])),
                max_size=8).map("".join))
def test_words_counted_alone_are_the_whole(tokenizer, text):
    counts = token_count.WordCounts(tokenizer, remember=8)
    want = len(tokenizer.encode(text, add_special_tokens=False).ids)
    assert counts.count([text, "", text + "a"])[:2] == [want, 0] and counts.count([text]) == [want]


def test_words_of_all_code_points(tokenizer):
    """The splitter and the tokenizer class every code point alike, or the text is left to the tokenizer."""
    texts = []
    for first in range(0x80, 0x30000, 64):
        chars = [chr(c) for c in range(first, first + 64) if not 0xD800 <= c < 0xE000]
        texts.append("".join(f"a{c}a 1{c}1 !{c}! {c}{c}" for c in chars))
    want = [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in texts]
    assert token_count.WordCounts(tokenizer).count(texts) == want
