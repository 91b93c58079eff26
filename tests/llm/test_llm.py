"""Operators of the llm subpackage against brute force, exact round trips and held-out accuracy, with odd rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from aeris.llm import (chat, decontaminate, exact_dedup, html_text, jaccard_join, lang_id, licenses, packing, queries,
                       repeats, warc)
from aeris.llm.common import read_table, shingles, ship

DOC = "doc_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sample(n=40, seed=5):
    """Documents with copies, near copies, long repeats, odd white space, nulls and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        out.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(6, 160)))))
    base = out[3][1] + " " + out[4][1]
    for i in range(n, n + 12):
        t = base.split()
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = "zzz"
        out.append((i, " ".join(t)))
    out += [(100, None), (101, ""), (102, " \t\n"), (103, out[0][1] + "\n\n"), (104, out[0][1].replace(" ", "  ")), (104, out[0][1]),
            (104, out[0][1]), (105, "one two three"), (106, "One, two; three!"), (107, "x" * 5000), (108, "é" * 900), (None, out[1][1])]
    return out


# ---------------------------------------------------------------- 5: exact dedup

def brute_exact(data):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(data):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((d, t or "", i))
    out = []
    for key, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        for d, _, _ in members:
            out.append((d, keep[0], len(members), hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_filter_grows_with_rows():
    assert exact_dedup.bits_for(0) == exact_dedup.bits_for(1) == 1 << 20
    assert exact_dedup.bits_for(1 << 20) == 1 << 23 and exact_dedup.bits_for((1 << 20) + 1) == 1 << 24
    assert exact_dedup.bits_for(10 ** 12) == exact_dedup.FILTER_BITS


@pytest.mark.parametrize("bits", [None, 64])
def test_exact_dedup(spark, bits):
    data = sample()
    df = spark.createDataFrame(data, DOC)
    got = exact_dedup.exact_dedup(df, filter_bits=bits)
    assert rows(got.select("doc_id", "keep_id", "group_size", "text_sha256")) == brute_exact(data)
    groups = {r["text_sha256"]: r["n"] for r in got.where("kept").groupBy("text_sha256").count().withColumnRenamed("count", "n").collect()}
    assert set(groups.values()) == {1} and len(groups) == got.select("text_sha256").distinct().count()


def test_exact_keep_one_keeps_columns(spark):
    data = [(d, t, d, "x") for d, t in sample()]
    df = spark.createDataFrame(data, "doc_id long, text string, _sha long, maybe string")
    got = exact_dedup.keep_one(df)
    assert got.columns == df.columns
    expected = {}
    for d, keep, _, sha in brute_exact([(d, t) for d, t, _, _ in data]):
        expected[sha] = keep
    assert sorted(map(repr, (r.doc_id for r in got.collect()))) == sorted(map(repr, expected.values()))
    assert exact_dedup.keep_one(df.limit(0)).count() == 0 and exact_dedup.exact_dedup(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 9: repeated strings

def brute_repeats(data, n=200):
    texts = [(d, (t or "").encode()) for d, t in data]
    seen = Counter(t[j:j + n] for _, t in texts for j in range(len(t) - n + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - n + 1):
            if seen[t[j:j + n]] > 1:
                gone[j:j + n] = b"\1" * n
        kept = bytes(x for x, y in zip(t, gone, strict=True) if not y)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [repeats._GROUP, 1])
def test_repeats(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "_GROUP", group)  # 1: every shared gram takes the way of very large groups
    data = sample()
    assert rows(repeats.remove_repeats(spark.createDataFrame(data, DOC))) == brute_repeats(data)


@pytest.mark.parametrize("hot, group", [(0, repeats._GROUP), (1, 1)])
def test_repeats_of_hot_grams(spark, monkeypatch, hot, group):
    """Grams beyond ``hot`` segments of a task are dealt by segment, and others of them elsewhere by gram."""
    monkeypatch.setattr(repeats, "_GROUP", group)
    data = sample()
    df = spark.createDataFrame(data, DOC)
    assert rows(repeats.remove_repeats(df.repartition(3), hot=hot)) == brute_repeats(data)
    assert rows(repeats.remove_repeats(df.coalesce(1), hot=hot)) == brute_repeats(data)


def test_repeats_met_in_earlier_buffers(spark):
    """Passages that return in every buffer of a task, whole and cut, between texts of their own."""
    rng = random.Random(3)
    passage = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([150, 230, 700]))) for _ in range(6)]
    data = []
    for i in range(90):
        own = "".join(rng.choice("abcdefgh ") for _ in range(14_000))
        p = rng.choice(passage)
        cut = rng.randrange(0, 60)
        data.append((i, own[:7000] + p[cut:] + own[7000:] + rng.choice(passage)))
    df = spark.createDataFrame(data, DOC)
    expected = brute_repeats(data)
    assert rows(repeats.remove_repeats(df.coalesce(1), hot=2)) == expected
    assert rows(repeats.remove_repeats(df.coalesce(1))) == expected


def test_met_tables():
    met = repeats.Met()
    g, e = np.array([5, 5, 9], np.uint64), np.array([1, 2, 1], np.uint64)
    assert met.segments(g, e, np.array([False, True, False])).tolist() == [0, 0, 0]
    assert met.segments(g, e, np.array([False, False, False])).tolist() == [1, 2, 1]
    assert met.segments(g[:1], e[:1], np.array([False])).tolist() == [2]
    assert met.grams(np.array([9, 5, 9, 9], np.uint64)).tolist() == [0, 0, 1, 2]
    assert met.grams(np.array([5, 9, 5], np.uint64)).tolist() == [1, 3, 2]
    assert met.grams(np.array([], np.uint64)).tolist() == []


def test_repeats_across_buffers(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))  # more than two buffers
    at = (1 << 19) - 150  # crosses the first buffer's end
    data = [(1, long), (2, "#" + long[at:at + 260] + "#"), (3, long[-230:])]
    got = {r[0]: r for r in rows(repeats.remove_repeats(spark.createDataFrame(data, DOC)))}
    assert got[1][2:4] == (490, 2) and got[2][2:4] == (260, 1) and got[3][2:4] == (230, 1)


# ---------------------------------------------------------------- 3: Jaccard join

def brute_join(data):
    sets = [set(shingles((t or "").encode()).tolist()) for _, t in data]
    n = len(data)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    links = [0] * n
    for a in range(n):
        for b in range(n):
            if a != b and sets[a] and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                root[find(a)] = find(b)
    members = defaultdict(list)
    for i in range(n):
        members[find(i)].append(i)
    out = []
    for group in members.values():
        ids = [data[i][0] for i in group if data[i][0] is not None]
        for i in group:
            out.append((data[i][0], min(ids, default=None), links[i], len(group)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket,block", [(jaccard_join.BUCKET, jaccard_join.BLOCK), (3, 2)])
def test_jaccard_join(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)  # small: nodes are split again, and compared in blocks
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    data = sample()
    assert rows(jaccard_join.jaccard_join(spark.createDataFrame(data, DOC))) == brute_join(data)


def test_jaccard_recall_below_split_nodes(spark, monkeypatch):
    runs = jaccard_join.runs_for()
    assert jaccard_join.missed(runs, 2) <= 1e-5 < jaccard_join.missed(runs, 3)
    assert jaccard_join.missed(runs + jaccard_join.more_runs(), jaccard_join.DEPTH) <= 1e-5
    monkeypatch.setattr(jaccard_join, "BUCKET", 3)
    monkeypatch.setattr(jaccard_join, "runs_for", lambda *_: 2)  # few runs, so that a loss shows
    rng = random.Random(6)
    pairs = []
    for i in range(300):  # pairs just above 0.8: two words of a text of 99 shingles differ
        text = [f"w{rng.randrange(10 ** 6)}" for _ in range(103)]
        near = text[:]
        near[20] = near[70] = "zzz"
        pairs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(near))]
    docs = spark.createDataFrame(pairs, DOC)
    sets = jaccard_join.sets(docs).select("key", "doc_id", "tokens", "paths", "later")
    # one path for all: every first node is large and split again
    large = sets.selectExpr("key", "tokens", "array(1L) as paths", "array(2L) as later")
    found = {r.node: r.root for r in jaccard_join.candidates(large).collect()}
    keys = {r.doc_id: r.key for r in sets.collect()}
    met = sum(found.get(keys[2 * i], -1) == found.get(keys[2 * i + 1], -2) for i in range(300))
    assert met == 300


def test_jaccard_keep_one(spark):
    data = sample()
    df = spark.createDataFrame([(*r, 1) for r in data], DOC + ", _row_key int")
    got = jaccard_join.keep_one(df)
    assert got.columns == df.columns
    classes = {(c, s) if s > 1 else (d, 1) for d, c, _, s in brute_join([r for r in data if (r[1] or "").strip()])}
    wordless = sum(1 for _, t in data if not (t or "").strip())
    assert got.count() == len(classes) + wordless


# ---------------------------------------------------------------- 6: packing

def test_packing(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    data = sample() + [(200, "a<|endoftext|>b Word, word. WORD... x.,. don't ÉTÉ é 3.14 ΑΣ"), (201, "tail " * 3000)]
    got = packing.pack(spark.createDataFrame(data, DOC), queries.tokenizer_path(), capacity=256, with_ids=True).collect()
    own = Counter()
    for d, t in data:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[s:s + 256], "<u4")
            own[(d, k, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == own
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= -(-sum(r.length for r in got) // 256) + 1


def test_packing_plan_covers_any_histogram():
    rng = np.random.default_rng(2)
    for capacity in (8, 64):
        for _ in range(20):
            counts = rng.integers(0, 30, capacity + 1) * (rng.random(capacity + 1) < 0.6)
            counts[0] = 0
            used = np.zeros_like(counts)
            for pattern, n in packing.plan(counts, capacity):
                assert sum(pattern) <= capacity and n > 0
                np.add.at(used, list(pattern), n)
            assert (used == counts).all()
    assert packing.plan(np.zeros(9, int), 8) == []


# ---------------------------------------------------------------- 8: languages

def test_language_id(spark, sf_small):
    docs = read_table(spark, sf_small, "documents")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "12 34!", None)], DOC + ", lang string")
    pred = {r.doc_id: r for r in lang_id.language_id(docs.select("doc_id", "text", "lang").unionByName(odd)).collect()}
    for d in (-1, -2, -3):
        assert (pred[d].lang_pred, pred[d].score) == ("und", 0.0)
    held = [(r.doc_id, r.lang) for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(pred[d].held_out for d, _ in held) and sum(p.held_out for p in pred.values()) >= len(held)
    assert sum(pred[d].lang_pred == g for d, g in held) >= 0.95 * len(held)
    assert all(0 <= p.score <= 1 for p in pred.values())
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in lang_id.language_id(unlabelled).select("lang_pred").distinct().collect()} == {"und"}
    assert lang_id.known_language(unlabelled).count() == docs.count()


SCRIPTS = {"en": (97, 26), "el": (0x3B1, 24), "ru": (0x430, 32), "ko": (0xAC00, 900), "zh": (0x4E00, 2500), "ja": (0x5500, 2500)}


def scripts(rng, g, n):
    """Words of a language's own letters, the first ones more frequent."""
    first, many = SCRIPTS[g]
    return " ".join("".join(chr(first + int(many * rng.random() ** 2)) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("limit", [{}, {"dense_bytes": 0}])
def test_language_id_knows_every_letter(limit):
    rng = random.Random(8)
    samples = {g: [scripts(rng, g, 40) for _ in range(3 if g == "en" else 1 + 3 * k)] for k, g in enumerate(SCRIPTS)}
    model = lang_id.Model(samples, **limit)
    names, _ = model.predict([scripts(rng, g, 60) for g in SCRIPTS for _ in range(5)])
    assert names == [g for g in SCRIPTS for _ in range(5)]
    texts = [scripts(rng, g, 9) + " x " + scripts(rng, h, 90) for g in SCRIPTS for h in SCRIPTS]
    assert (model.rates(texts)[0] == lang_id.Model(samples).rates(texts)[0]).all()


def test_every_label_is_learned(spark):
    rng = random.Random(9)

    def text(k, n):
        return " ".join("".join(chr(0x4E00 + 12 * k + rng.randrange(12)) for _ in range(3)) for _ in range(n))

    data = [(1000 * k + i, text(k, 5), f"g{k}") for k in range(230) for i in range(4)]  # many labels, short texts only
    data += [(10 ** 6 + i, text(300, 2 if i % 20 else 20), "mixed") for i in range(3000)]
    data += [(None, text(301, 20), "no id") for _ in range(700)] + [(8, text(302, 20), "one")] * 900
    data += [(2 * 10 ** 6 + i, "... 12345 " * 6, "digits") for i in range(9)]
    rng.shuffle(data)
    docs = spark.createDataFrame(data, DOC + ", lang string")
    got = lang_id.training_rows(docs).collect()
    learned = Counter(r.lang for r in got)
    open_ = {g for d, _, g in data if d is None or zlib.crc32(str(d).encode()) % 4 != 2} - {"digits"}
    assert set(learned) == open_ and len(open_) > 225 and learned["mixed"] == learned["no id"] == 96
    assert all(len(r.text) >= 40 for r in got if r.lang == "mixed") and len(learned) == len(lang_id.fit(docs).langs)
    pred = lang_id.language_id(docs.where("lang in ('g1', 'g77', 'g200', 'one')").union(docs.where("lang = 'mixed'").limit(50)))
    assert pred.select("lang_pred").distinct().count() == 5


def test_small_labels_take_no_other_texts(spark, sf_small):
    docs = read_table(spark, sf_small, "documents").select("doc_id", "text", "lang")
    small = spark.createDataFrame([(-10, "ab", "x1"), (-12, "the", "x2"), (-14, "una de el", "x3"), (-16, "12 34", "x4")],
                                  DOC + ", lang string")
    model = lang_id.fit(docs.unionByName(small))
    pred = {r.doc_id: r.lang_pred for r in lang_id.identify(docs, model).collect()}
    held = [(r.doc_id, r.lang) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(model.langs) > docs.select("lang").distinct().count() and "x4" not in model.langs
    assert sum(pred[d] == g for d, g in held) >= 0.95 * len(held)


def test_cross_parsing_by_brute_force():
    samples = {"a": ["the cat sat on the mat"], "b": ["der hund und die katze"]}
    model = lang_id.Model(samples)
    known = {g: "".join(map(chr, lang_id.normal(t[0] + " "))) for g, t in samples.items()}

    def phrases(text, own, block):
        n = 0
        for s in range(0, len(text), block):
            part = text[s:s + block]
            i = 0
            while i < len(part):
                k = 1
                while i + k < len(part) and part[i:i + k + 1] in own:
                    k += 1
                i += k
                n += 1
        return n

    for text in ("the katze sat", "hund", "xyz the und!", "a" * 700):
        plain = "".join(map(chr, lang_id.normal(text)))
        rate, _ = model.rates([text], block=8)
        for j, g in enumerate(model.langs):
            expected = phrases(plain, known[g], 8) * np.log2(len(known[g])) / len(plain)
            assert rate[0, j] == pytest.approx(expected)


# ---------------------------------------------------------------- 2: licences

def test_license_scan(spark):
    mit = licenses.TEMPLATES["mit"]
    data = [(1, None), (2, ""), (3, "Released UNDER the MIT-License. cc by nc"), (4, "x " * 500 + mit.replace("sell", "SELL") + " y" * 30),
            (5, "apache license, version 2.0 and Apache License version 2"), (6, "under the mit licence"), (7, mit[:len(mit) // 4]),
            (7, "cc by cc by nc nc")]
    got = licenses.license_scan(spark.createDataFrame(data, DOC)).collect()
    for (d, t), r in zip(sorted(data, key=repr), sorted(got, key=lambda r: (r.doc_id, -r.n_words if r.doc_id == 7 else 0)), strict=True):
        assert r.doc_id == d
    for d, t in data:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        starts = [i for p in licenses.BASE for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        labels = sorted({g for p, g in licenses.BASE.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()})
        r = next(x for x in got if x.doc_id == d and x.n_words == len(words))
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(starts), min(starts, default=None), max(starts, default=None), ",".join(labels))
    by_id = {r.doc_id: r for r in got}
    assert by_id[4].labels == "mit" and by_id[4].score == pytest.approx(1.0) and by_id[4].spans[0].first == 500
    assert by_id[6].labels == ""


# ---------------------------------------------------------------- 4: WARC

def test_warc_round_trip(spark, tmp_path):
    data = [(1, "http://a/", "<p>x</p>"), (5, "http://b/\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (2, "u", "é" * 3000),
            (9, "u", "only"), (None, "n", "<p>x</p>")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    got = {r.page_id: r for r in warc.read_records(spark, path).collect()}
    best = {}
    for d, _, h in data:
        best[h or ""] = max(best.get(h or "", -1), -1 if d is None else d)
    for d, _, h in data:
        b = (h or "").encode()
        assert got[d].payload_bytes == len(b)
        assert got[d].payload_digest == base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert (got[d].record_type, got[d].refers_to) == (("response", None) if best[h or ""] == d else ("revisit", best[h or ""]))
    assert spark.read.parquet(f"{path}/payloads").count() == len(best)
    for r in warc.records(spark, path).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert block[length:] == b"\r\n\r\n" and (length == 0 or block[:length] == bytes(r.payload))
    empty = str(tmp_path / "empty")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_records(spark, empty).count() == 0


# ---------------------------------------------------------------- 1: main text

@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain  text", "plain text"),
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>a &amp; b<br>c</p></article><footer>f</footer></body></html>",
     "T a & b c"),
    ("<body><div class='ad'>Buy</div><article><header><h1>H</h1></header><p>One<p>Two <b>x</b>y</article><div id=comments>c</div>",
     "H One Two xy"),
    ("<body><article><p>cut &am", "cut &am"), ("<body><article><p>a<script>if (a<b) x()</script>b</p><p>c</p><p class", "ab c"),
    ("<body><div id=content><p>A long paragraph of text.</p><p>Another one, with more text.</p></div><ul><li><a href=1>l</a></li></ul>",
     "A long paragraph of text. Another one, with more text."),
    ("<main><p>x</p><aside>no</aside><form>no</form><section class='reader-comments'>no</section></main>", "x"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def _page(*blocks):
    return "<body><div id=wrap>" + "".join(blocks) + "</div></body>"


STORY = ["The harbour was quiet that morning, and the first boats came back with little more than rope and weather.",
         "By noon the market had opened all the same; the women laid out what there was and the buyers took their time.",
         "Nobody spoke of the storm until the evening, when the last of the missing boats was seen beyond the point."]


@pytest.mark.parametrize("beside", [
    "<div><div><a href=1>Home</a></div><div><a href=2>News</a></div><div>Weather</div><div>Sport</div></div>",
    "<div>Terms have changed.</div>", "<div><span>Buy</span> <span>two</span> <span>boats</span></div>", "All rights kept."])
def test_main_text_is_the_core(beside):
    story = "<div class=x>" + "".join(f"<p>{p}</p>" for p in STORY) + "</div>"
    for page in (_page(beside, story), _page(story, beside), f"<body>{beside}{story}</body>",
                 _page(beside, f"<div>{story}{beside}</div>"), _page(story, beside, "<article><h2>Read on</h2><p>A card.</p></article>")):
        assert html_text.main_text(page) == " ".join(STORY)


def test_main_text_keeps_dense_neighbours():
    story = "<div class=x>" + "".join(f"<p>{p}</p>" for p in STORY) + "</div>"
    half = len(STORY[0]) // 2
    head, tail = STORY[0][:half].rstrip(), STORY[0][half:].lstrip()
    for more in (f"<p>{STORY[0]}</p>", f"{head} <i>{tail}</i>", f"{head}<br>{tail}"):
        text = " ".join([head, tail, *STORY]) if "<p>" not in more else " ".join([STORY[0], *STORY])
        assert html_text.main_text(_page(more, "<div>Terms</div>", story)) == text


@pytest.mark.parametrize("name", [
    "content has-sidebar", "no-sidebar", "post with-comments", "hasSidebar", "search-result", "content sidebar-right", "widget",
    "social", "overlay content", "ads-free", "comments-open", "adbox"])
def test_marked_wrappers_keep_their_text(name):
    paragraphs, story = "".join(f"<p>{p}</p>" for p in STORY), " ".join(STORY)
    menu, notes = "<div class=menu><p>Home</p><p>News</p></div>", f"<div class=comments><p>{STORY[0]}</p><p>{STORY[1]}</p></div>"
    for inner, text in ((f"<article><div class=entry-header><h1>Harbour</h1></div>{paragraphs}{notes}</article>", "Harbour " + story),
                        (f"<article><div class='{name}'>{paragraphs}</div></article>", story), (paragraphs, story)):
        beside = f"{menu}<div class=notice>Terms</div>" if name != "adbox" or "<article>" in inner else ""
        assert html_text.main_text(f"<body>{beside}<div class='{name}'>{inner}</div>{beside}</body>") == text


def test_marked_blocks_beside_the_text_go():
    paragraphs = "".join(f"<p>{p}</p>" for p in STORY)
    long = "<div id=comments><article class=comment>" + paragraphs * 3 + "</article></div><div class=cookie-consent>" + paragraphs * 4 + "</div>"
    for inner in (f"<article>{paragraphs}<div class=related><p>{STORY[0]}</p></div></article>", f"<div>{paragraphs}</div>"):
        page = f"<body><div class=sidebar><p>{STORY[1]}</p></div>{inner}{long}</body>"
        assert html_text.main_text(page) == " ".join(STORY)


def test_extract_rows_and_depth(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    df = spark.createDataFrame([(1, "u", None, 0), (2, None, deep, 0), (2, None, deep, 0)],
                               "page_id long, url string, html string, text int")
    assert rows(html_text.extract(df)) == sorted([(1, "u", "", 0), (2, None, "deep", 4), (2, None, "deep", 4)], key=repr)
    assert html_text.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 7: conversations

def test_chat_collapse(spark):
    rng = random.Random(4)
    logs = {}
    for c in range(30):
        logs[c] = [(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.randint(1, 5))]
    logs[40], logs[41] = logs[3][:], logs[3] + [("user", "more")]
    logs[42] = [("user", "t%d" % (i % 7)) for i in range(1500)]  # several blocks
    logs[43] = logs[42][:1100]
    data = [(c, i, r, t) for c, turns in logs.items() for i, (r, t) in enumerate(turns)]
    data += [data[0], (None, 0, "user", "x"), (50, None, None, None), (51, 7, "", "")]
    logs[50], logs[51] = [("", "")], [("", "")]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    expected = []
    for c, turns in logs.items():
        same = [d for d, other in logs.items() if other == turns]
        longer = any(len(o) > len(turns) and o[:len(turns)] == turns for o in logs.values())
        if min(same) == c and not longer:
            expected.append((c, len(turns), len(same), "".join(f"<|{r}|>\n{t}\n" for r, t in turns)))
    assert rows(chat.collapse(df)) == sorted(expected, key=repr)
    assert chat.collapse(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 10: decontamination

BENCH = [(1, "Maria has 12 apples and gives 5 kg to her friend, so how many are left in the basket of Maria today"),
         (2, "short item of five words"), (3, None), (4, "1 2 3 4 5 6 7 8 9 10 11 12"), (4, "1 2 3 4 5 6 7 8 9 10 11 12")]


def test_decontaminate(spark):
    ask = "Look, Peter has 31 apples and gives 7 kg to her friend, so how many are left in the basket of Peter today. End."
    wrong = ask.replace("basket of Peter", "basket of Karl").replace("Look, Peter", "Look, Maria")
    data = [(1, "Text before. " + BENCH[0][1] + " and after."), (2, ask), (3, None), (4, ""), (5, "a short item of five words here"),
            (6, "12 11 10 9 8 7 6 5 4 3 2 1"), (7, "nothing of the kind, really, in this whole text at all"), (2, ask), (None, ask)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in data], DOC + ", _leak_id int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 2)}
    assert got[(1, 1)].n_changed == 0 and got[(2, 1)].n_changed > 0
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [3, 4, 6, 7, None]))
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0
    slips = spark.createDataFrame([(1, wrong)], DOC)
    assert all(r.covered < r.n_words for r in decontaminate.matches(slips, bench).collect())


def test_decontaminate_finds_copies_of_any_words(spark):
    items = ["1 2 3 4 5 6 7 8 9 10 11 12", "7 8", "Anna, Bert, Carla, Dora, Emil, Fritz, Gerda, Hans, Ida, Jakob", "3 kg 5 km 9 cm",
             "x = 14 + 25 * 36 / 47 so 58"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    turned = [" ".join(reversed(x.split())) for x in items]
    data = [(10 + i, f"Some words before it. {x} and words after it") for i, x in enumerate(items)] + \
        [(20 + i, f"Some words before it. {x} and words after it") for i, x in enumerate(turned)] + [(30, "3 kg 6 km 9 cm")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(spark.createDataFrame(data, DOC), bench).collect()}
    assert set(got) == {(10 + i, i) for i in range(5)} | {(10, 1)}
    assert all(r.covered == r.n_words and r.n_changed == 0 for r in got.values())


def test_decontaminate_finds_copies_in_any_setting(spark):
    long = "The ferry to Vardo leaves the quay of Old Bergen at nine, and Captain Nilsen never waits for late guests."
    short = "Maria buys ten red apples from old Peter"
    bench = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    forms = [lambda x: x, str.lower, str.upper, str.title, lambda x: x.replace(" ", "\n"), lambda x: x.replace(" ", "  "),
             lambda x: x.replace(" ", "\u00a0"), lambda x: "we know, " + x]
    data = [(100 * item + k, "A word, " + f(x) + " and so on") for item, x in ((1, long), (2, short)) for k, f in enumerate(forms)]
    data.append((300, "The ferry to\nTromso leaves the quay of  Old\nMolde at nine, and\r\nCaptain Hansen never waits for late guests."))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(spark.createDataFrame(data, DOC), bench).collect()}
    assert set(got) == {(100 * item + k, item) for item in (1, 2) for k in range(len(forms))} | {(300, 1)}
    assert all(r.covered == r.n_words for r in got.values()) and got[(300, 1)].n_changed == 3


def test_decontaminate_without_python(spark, sf_small):
    df = decontaminate.matches(read_table(spark, sf_small, "documents"), read_table(spark, sf_small, "benchmark"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---------------------------------------------------------------- broken markup, shared ids, odd letters

PARAGRAPHS = ["word " * 60 + "one.", "text " * 60 + "two.", "para " * 60 + "three."]


@pytest.mark.parametrize("tag", ["<p title=John's>", '<p class="x"">', '<p class=x">', "<p a='1'b=\"2>3\" c>", "<p =x>", "<p a=>", "<p a=b/c>"])
def test_html_odd_quotes_lose_no_text(tag):
    page = f"<html><body><div><p>{PARAGRAPHS[0]}</p>{tag}{PARAGRAPHS[1]}</p><p>{PARAGRAPHS[2]}</p></div></body></html>"
    assert html_text.main_text(page) == " ".join(PARAGRAPHS)


@pytest.mark.parametrize("wrap", ["<form>{}</form>", "<main><form action=x>{}<input name=q><button>Go</button></form></main>",
                                  "<form><article>{}</article></form>"])
def test_html_page_in_a_form(wrap):
    body = wrap.format("".join(f"<p>{p}</p>" for p in PARAGRAPHS))
    assert html_text.main_text(f"<html><body>{body}</body></html>") == " ".join(PARAGRAPHS)


def test_html_a_form_beside_the_text_goes():
    form = "<form><p>Your name and your address please</p><label>Name</label><input></form>"
    page = f"<html><body><div>{''.join(f'<p>{p}</p>' for p in PARAGRAPHS)}{form}</div></body></html>"
    assert html_text.main_text(page) == " ".join(PARAGRAPHS)


def test_html_many_stray_end_tags_are_quick():
    import time
    began = time.time()
    html_text.main_text("<b>" * 20000 + "</i>" * 20000 + "x")
    assert time.time() - began < 5


def test_leaks_under_a_shared_id(spark):
    item = "A train leaves the station at 9 hours and travels 120 miles to the next town before it stops for water"
    other = "completely different words stand in this second text which has the same number as the first one does here"
    changed = item.replace("9", "7").replace("120", "85")
    docs = [(1, item), (1, other), (2, changed), (2, other), (2, None), (3, other)]
    d = spark.createDataFrame(docs, DOC)
    b = spark.createDataFrame([(10, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_changed for r in decontaminate.matches(d, b).collect()}
    assert got == {(1, 10): 0, (2, 10): 2}
    kept = sorted(((r.doc_id, r.text) for r in decontaminate.without_leaks(d, b).collect()), key=repr)
    assert kept == sorted([(1, other), (2, other), (2, None), (3, other)], key=repr)


def test_packing_ids_of_random_texts():
    tokens = packing.WordTokens(queries.tokenizer_path())
    rng = random.Random(8)
    bits = ["İ", "Σ", "ΑΣ", "ß", "x", "word", ".", ",", ". ", ", ", " ", "\n", "<|", "|>", "<|endoftext|>", "é", "é", "!", "9", "'s", "漢", "...", ".,", "Ǆ"]
    texts = ["x <|y|> İ. end"] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for at in range(0, len(texts), 500):
        part = texts[at:at + 500]
        ids, sizes = tokens.encode(part)
        own = np.split(ids, np.cumsum(sizes)[:-1])
        for t, got in zip(part, own, strict=True):
            assert got.tolist() == tokens.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_licence_phrases_shorter_than_three_words(spark):
    data = [(1, "released xx mit license ok"), (2, "free"), (3, "mit"), (4, "under mit license"), (5, None)]
    got = licenses.license_scan(spark.createDataFrame(data, DOC), base={"mit license": "mit", "free": "free"})
    assert {r.doc_id: (r.n_base, r.base_labels) for r in got.collect()} == {
        1: (1, "mit"), 2: (1, "free"), 3: (0, ""), 4: (1, "mit"), 5: (0, "")}
