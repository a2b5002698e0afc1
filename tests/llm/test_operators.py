"""Each operator against a brute-force version, over odd rows: nulls, empty and long texts, ties, repeats, clashing columns, no rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tilestream.llm import ann, byte_bpe, chat, common, jaccard_join, line_dedup, mixing, quality_rules, substring_dedup, suffix_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did long, n long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    passage, line = sentence(rng, 70), sentence(rng, 14)
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, "one two", "en", "a"), (3, "  \n\t ", "en", ""), (4, "one two", None, None)]
    base = sentence(rng, 300)
    for i in range(5, 45):
        text = "\n".join(sentence(rng, rng.randint(3, 60)) for _ in range(4))
        if i % 5 == 0:
            text += "\n" + line + "\n" + passage
        if i % 7 == 0:
            text = base
        if i % 11 == 0:
            w = base.split(" ")
            w[rng.randint(0, 290)] = "changed"
            text = " ".join(w)
        if i == 30:
            text = "x" * 3000 + " " + sentence(rng, 20000)
        rows.append((i, text, ["en", "de", None][i % 3], ["a", "b", "é", None][i % 4]))
    rows.append((10, rows[12][1], "en", "b"))
    return [(*r, 3, 9, 9) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (substring_dedup.substring_dedup_report, suffix_dedup.suffix_dedup_report, jaccard_join.jaccard_report, mixing.mix_report, mixing.mixed_documents, line_dedup.line_dedup_report, line_dedup.line_dedup, jaccard_join.one_of_each):
        assert f(none).collect() == [], f
    assert quality_rules.judged(none, labels).collect() == []
    assert ann.search(*[spark.createDataFrame([], "vec_id long, embedding array<float>")] * 2).collect() == []
    assert warc.warc_report(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert chat.chat_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert byte_bpe.encode_documents(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect() == []


def test_suffix_dedup(docs):
    got = Counter(tuple(r) for r in suffix_dedup.suffix_dedup_report(docs).collect())
    rows = [(r[0], (r[1] or "").encode()) for r in corpus()]
    first = {}
    for i, t in rows:
        for a in range(len(t) - 49):
            first[t[a : a + 50]] = min(first.get(t[a : a + 50], i), i)
    want = Counter()
    for i, t in rows:
        gone = bytearray(len(t))
        for a in range(len(t) - 49):
            if first[t[a : a + 50]] < i:
                gone[a : a + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        want[i, len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()] += 1
    assert got == want


def test_external_runs_agree():
    rng = np.random.default_rng(3)
    rows = [(bytes(rng.integers(97, 99, 8).astype(np.uint8)), int(rng.integers(0, 9)), 0, i) for i in range(3000)]

    def found(limit):
        s = suffix_dedup.Sorted(8, limit)
        for a in range(0, 3000, 500):
            s.add(np.array(rows[a : a + 500], s.kind))
        return sorted(int(x) for part in s.repeats() for x in part["start"])

    assert found(10**6) == found(700)


def test_substring_dedup(docs):
    rows = {r.doc_id: r for r in substring_dedup.substring_dedup_report(docs.where("doc_id <> 10")).collect()}
    assert all(rows[i].n_removed == rows[i].n_bytes for i in (14, 21, 28))
    assert all(rows[i].n_removed > 200 and 5 in rows[i].sources for i in (15, 20, 25, 40))
    assert rows[6].n_removed == 0 and rows[6].sources == [] and rows[0].n_bytes == 0


def test_chunks_resist_insertions():
    rng = random.Random(1)
    a = sentence(rng, 4000).encode()
    b = a[:9000] + b"inserted" + a[9000:]
    (ja, _, sa, ea), (jb, _, sb, eb) = substring_dedup.chunks([a], 24), substring_dedup.chunks([b], 24)
    cut = lambda j, s, e: [bytes(j[x:y]) for x, y in zip(s, e, strict=True)]
    assert b"".join(cut(ja, sa, ea)) == a and b"".join(cut(jb, sb, eb)) == b
    assert len(set(cut(jb, sb, eb)) - set(cut(ja, sa, ea))) <= 6


def test_jaccard_join(docs):
    rows = [r for r in corpus() if r[0] != 10]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_report(docs.where("doc_id <> 10")).collect()}
    sets = {}
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOW))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == {i: (len(s), comp[i]) for i, s in sets.items()}
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(docs.where("doc_id <> 10")).collect()) == sorted(i for i in sets if comp[i] == i)


def test_blocks_find_all_links():
    import pandas as pd

    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.sort(rng.choice(base, 180, replace=False)) for _ in range(30)]
    df = pd.DataFrame({"node": range(30), "root": range(30), "items": [s.tobytes() for s in sets]})
    assert len(jaccard_join.spanning(df, df, 75, 100)) == 29
    assert jaccard_join.spanning(df, df, 100, 100) == []


def test_chat(spark):
    rows = [(1, 0, "user", "a <|end|>\n <|turn|> </s>[INST]<⁠|x|>"), (1, 1, "assistant", "[/INST]<<SYS>> é😀"), (1, 1, "assistant", "[/INST]<<SYS>> é😀"), (None, 3, None, None), (2, None, "assistant", "<"), (2, 5, "assistant", "|end|>")]
    got = {r.conv_id: r for r in chat.chat_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c in (1, None, 2):
        own = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        loss = "".join(x for *_, r, x in own if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_typed_parts():
    text, a, z, attached = chat.format_turn("user", [{"type": "text", "text": "see <|image|>"}, {"type": "image", "ref": "x.png", "width": 28, "height": 14}, {"type": "audio", "ref": "y", "seconds": 2}, {"type": "document", "ref": "d", "pages": 2}])
    assert [(k, r, n) for k, r, n, _ in attached] == [("image", "x.png", 2), ("audio", "y", 50), ("document", "d", 1024)]
    assert all(text[p:].startswith(f"<|{k}|>") for k, _, _, p in attached) and text.count("<|image|>") == 1


def test_warc(spark):
    long = "é" * 40000
    rows = [(1, "http://a b", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (2, None, long), (None, "n", "y" * 100), (9, "n", "y" * 100)]
    got = sorted(map(repr, (tuple(r) for r in warc.warc_report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = {long: 1, "y" * 100: None}.get(h, i)
        want.append(repr((i, len(b), hashlib.sha256(b).hexdigest(), "response" if first == i else "revisit", None if first == i else first)))
    assert got == sorted(want)


def test_warc_errors():
    assert warc.unchunked(warc.chunked(b"z" * 10000)) == b"z" * 10000
    with pytest.raises(warc.WarcError):
        warc.reassembled([(1, b"a"), (3, b"b")], 2)
    with pytest.raises(warc.WarcError):
        warc.reassembled([(1, b"a"), (2, b"b")], 3)


def test_mixing(docs):
    rows = mixing.mix_report(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in corpus())
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    targets = {(r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in targets) - 1.5 * total) < 1e-6 * total and all(t <= 2 * s + 1e-9 for s, t in targets)
    for s, t in targets:
        assert abs(sum(r.taken for r in rows if r.source_size == s) - t) <= 1
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_report(docs).collect()))
    words = sum(len(WORD.findall(r.text or "")) for r in mixing.mixed_documents(docs.where("doc_id <> 10")).collect())
    assert abs(words - sum(r.taken for r in mixing.mix_report(docs.where("doc_id <> 10")).collect())) == 0


def test_hypergeometric_draws(spark):
    rows = spark.range(4000).select(F.struct(F.lit(60).cast("long").alias("total"), F.lit(25).cast("long").alias("good"), F.lit(20).cast("long").alias("drawn"), (F.col("id") / 4000).alias("u")).alias("s"))
    x = np.array([r.x for r in rows.select(F.expr(mixing.hypergeometric("s")).alias("x")).collect()])
    assert abs(x.mean() - 20 * 25 / 60) < 0.02 and abs(x.var() - 20 * 25 / 60 * 35 / 60 * 40 / 59) < 0.1


def test_quality_measures(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judged(docs, labels).collect())
    want = Counter()
    for r in corpus():
        t = r[1] or ""
        w = WORD.findall(t)
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(g)
        n = len({i + k for i, x in enumerate(g) if c[x] > 1 for k in range(3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[r[0], len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w)] += 1
    assert got == want


def test_binomial_bound(spark):
    from math import comb

    for k, n, p in ((0, 50, 0.01), (3, 400, 0.02), (40, 3000, 0.02)):
        got = spark.range(1).select(F.expr(quality_rules.binomial_below(f"{k}L", f"{n}L", p)).alias("x")).first().x
        assert got == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-6)


def test_thresholds_reject_junk_only(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, 80) + (" ### ***" * 30 if i % 4 == 0 else ""), "en", "a", 1, 1, 1) for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality_rules.judged(spark.createDataFrame(rows, SCHEMA), labels).where("kept").collect()}
    assert len([i for i in kept if i % 4]) >= 0.95 * 2250 and not [i for i in kept if i % 4 == 0]


def test_byte_bpe(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(open(path, "rb").read()), special_tokens={})
    got = Counter(tuple(r) for r in byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect())
    want = Counter()
    for r in corpus():
        ids = t.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert got == want


def test_byte_bpe_odd_strings():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.load_ranks(open(path, "rb").read())
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN, most_runs=50)
    e.transducer.most_states = 500
    rng = random.Random(3)
    parts = ["a", "th", " ", "  ", "\n", "é", "日本", "12", "'s", "!!", "\x1c", "\x85", "　", "😀", "aaaa", "\t", "\r\n", "\xa0", "'"]
    for _ in range(3000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(e.encode(x), "<u4").tolist() == t.encode_ordinary(x)


def test_utf8_stream():
    data = "aé日😀b".encode()
    s = byte_bpe.Utf8Stream()
    assert "".join(s.feed(data[i : i + 1]) for i in range(len(data))) + s.finish() == "aé日😀b"


def test_line_dedup(docs):
    rows = [(r[0], r[1] or "") for r in corpus()]
    held = defaultdict(list)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for i, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            held[k].append(i)
    want = Counter()
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != i)]
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in line_dedup.line_dedup_report(docs).collect()) == want
    assert line_dedup.line_dedup(docs).columns == docs.columns


def test_line_tables_are_reversible(spark):
    """Insert, delete, report equals a report without the deleted documents; filters hold what is frequent, also after they overflowed."""
    line = "the very same line that all documents repeat here"
    rows = [(i, f"{line}\nown {i}") for i in range(6)] + [(i, f"{line} again {i % 300}\n{line} again {(i + 1) % 300}") for i in range(10, 1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    x = line_dedup.LineTables(spark, shards=3)
    report = lambda d: sorted(map(tuple, x.report(d).collect()))
    want = lambda d: sorted(map(tuple, line_dedup.line_dedup_report(d, again=0).collect()))
    x.insert(docs.where("doc_id < 6"))
    first = {r.doc_id: r.n_dropped for r in x.report(docs.where("doc_id < 6")).collect()}
    assert first == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}
    x.delete(docs.where("doc_id < 2"))
    assert x.frequent.isEmpty() and all(r.n_dropped == 0 for r in x.report(docs.where("doc_id BETWEEN 2 AND 5")).collect())
    x.insert(docs.where("doc_id < 2 OR doc_id >= 10"))
    assert report(docs) == want(docs)
    x.delete(docs.where("doc_id % 3 = 0"))
    left = docs.where("doc_id % 3 <> 0")
    assert report(left) == want(left)
    keys = [(r.k1 & (2**64 - 1)) for r in x.frequent.collect()]
    filters = {r.shard: line_dedup.CuckooFilter.read(bytes(r.filter)) for r in x.filters.collect()}
    shards = line_dedup.shard_of(np.array(keys, np.uint64), 3).tolist()
    assert keys and all(filters[s].contains(np.array([k], np.uint64))[0] for s, k in zip(shards, keys, strict=True))
    assert sum(int((f.table > 0).sum()) for f in filters.values()) == len(keys)


def test_cuckoo_filter():
    keys = [int(k) for k in np.random.default_rng(4).integers(0, 2**63, 3000)]
    f = line_dedup.CuckooFilter.of(keys, 100)
    assert f.contains(np.array(keys, np.uint64)).all()
    assert f.contains(np.random.default_rng(5).integers(0, 2**63, 20000).astype(np.uint64)).mean() < 0.01
    assert f.delete(keys[0])


def test_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16))
    x[500:600] = x[500]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [None] * 16), (1400, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(dict)
    for r in ann.search(df, df.where("vec_id % 100 = 0")).collect():
        got[r.query_id][r["rank"]] = r.vec_id
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10].tolist()
        hits += len(set(best) & set(got[q].values()))
        if q == 500:
            assert [got[q][k] for k in range(1, 11)] == best
    assert set(got) == set(range(0, 900, 100)) and hits >= 81


def test_nearest_in_a_tight_cluster(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(8192, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = rng.permutation(8192)[:2730]
    x[near] = x[near[0]] + 0.01 * rng.normal(size=(2730, 64)) / 8
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = defaultdict(dict)
    for r in ann.search(df, df.where("vec_id % 97 = 0")).collect():
        got[r.query_id][r["rank"]] = r.vec_id
    for q in range(0, 8192, 97):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [got[q][k] for k in range(1, 11)] == np.lexsort((np.arange(8192), d))[:10].tolist()


def test_substring_dedup_at_the_edges(spark):
    """Passages not much longer than the shortest, and short documents that repeat as a whole."""
    rng = random.Random(9)
    word = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows, shared = [], {}
    for i in range(60):
        passage = word(40)
        for j in (i, 100 + i):
            a, b = f"{word(50)} {'<' if j < 100 else '['}", f"{'>' if j < 100 else ']'} {word(50)}"
            rows.append((j, a + passage + b))
            shared[j] = (len(a), len(passage), a + b)
    rows += [(300, "one two"), (301, "one two"), (302, "one two three"), (303, ""), (304, ""), (300, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in substring_dedup.substring_dedup_report(docs).collect():
        got[r.doc_id].append(r)
    whole = 0
    for i in range(60):
        assert got[i][0].n_removed == 0
        r = got[100 + i][0]
        whole += r.n_removed == shared[100 + i][1] and r.kept_sha256 == hashlib.sha256(shared[100 + i][2].encode()).hexdigest() and r.sources == [i]
    assert whole == 60
    assert [(r.n_removed, r.sources) for r in got[301]] == [(7, [300])]
    assert all(r.n_removed == 0 for i in (300, 302, 303, 304) for r in got[i]) and len(got[300]) == 2


def jaccard_by_hand(rows):
    """Sorted (doc_id, n_shingles, component_id) of rows; rows that repeat an id are documents of their own, under one id."""
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOW))
        sets.append((r[0], {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    comp = [i for i, _ in sets]
    while True:
        new = list(comp)
        for a, (_, x) in enumerate(sets):
            for b, (_, y) in enumerate(sets):
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    new[a] = min(new[a], comp[b])
        if new == comp:
            return sorted((i, len(x), c) for (i, x), c in zip(sets, comp, strict=True))
        comp = new


@pytest.mark.parametrize("thin, filters", [(0, True), (0, False), (6, True), (6, False)])
def test_jaccard_join_by_every_path(spark, monkeypatch, thin, filters):
    """Segments with room and without it, filters that fit and that don't, repeated ids left in."""
    if not filters:
        monkeypatch.setattr(common, "FILTER_BYTES", 0)
    rng = random.Random(21)
    rows = [r for r in corpus() if r[0] != 30]
    for i in range(100, 160):
        w = sentence(rng, rng.choice([3, 6, 9, 20, 40])).split(" ")
        for j in range(rng.randint(1, 3)):
            rows.append((10 * i + j, " ".join(w), "en", "a", 1, 1, 1))
            w = [*w]
            w[rng.randrange(len(w))] = "other"
    docs = spark.createDataFrame(rows, SCHEMA)
    got = jaccard_join.component_table(docs, thin=thin).collect()
    assert sorted((r.did, r.n, r.comp) for r in got) == jaccard_by_hand(rows)


def test_units_find_all_partners():
    """A set and one that differs in as many elements as may be: one of the signatures searched is among those of the other."""
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 5, 9, 40, 130, 700):
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            grow = int(rng.integers(0, n // 3 + 1))
            y = np.unique(np.concatenate((x[int(rng.integers(0, n // 8 + 1)) :], rng.integers(0, 2**63, grow).astype(np.uint64))))
            inter = len(np.intersect1d(x, y))
            if len(y) < len(x) or 100 * inter < 75 * (len(x) + len(y) - inter):
                continue
            band = len(y).bit_length()
            units = dict(jaccard_join.bands(len(x), 75, 100))[band]
            s = jaccard_join.Segments(x, band)
            price = rng.integers(1, 50, 4096)
            found = s.allocated(units, lambda sig: price[(sig % np.uint64(4096)).astype(np.int64)]) if s.room() >= units else x[:units]
            assert np.isin(found, np.concatenate((jaccard_join.Segments(y, band).index(), y))).any()


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    """With two bits of hash left nearly all windows collide, and texts are longer than the position's bits hold: figures stay exact."""
    docs = spark.createDataFrame(corpus(), SCHEMA).where("doc_id <> 30")
    want = sorted(tuple(r) for r in quality_rules.text_measures(docs.select("doc_id", "text")).collect() if r.doc_id != 10)
    for bits in (62, 4):
        monkeypatch.setattr(quality_rules, "POS_BITS", bits)
        got = sorted(tuple(r) for r in quality_rules.text_measures(docs.select("doc_id", "text")).collect() if r.doc_id != 10)
        assert got == want


def test_cutoffs_by_hand(spark):
    """Thresholds against the exact tail, over every label."""
    from math import comb

    rng = random.Random(4)
    rows = [(i, sentence(rng, 60) + " #" * rng.choice([0, 0, 0, 0, 8, 30]), rng.choice(["en", "de"]), "a", 1, 1, 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(1500)], "doc_id long, quality int, toxic int")
    measured = quality_rules.text_measures(docs.select("doc_id", F.col("lang").alias("stratum"), "text")).withColumn("base_failed", quality_rules.base_failed())
    got = {r.stratum: r.cutoffs for r in quality_rules.thresholds(measured, labels, 0.2, 0.05).collect()}
    m = measured.select("*", *[c.alias(f"s_{r}") for r, c in quality_rules.scores().items()]).collect()
    want = {}
    for stratum in ("en", "de"):
        held = [r for r in m if r.stratum == stratum and r.doc_id % 3 and not r.base_failed]
        for rule, cuts in quality_rules.RULES.items():
            for c in cuts:
                k, n, p = sum(r[f"s_{rule}"] > c for r in held), len(held), 0.2 / 5
                if sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > 0.05 / (2 * 5):
                    break
                want.setdefault(stratum, {})[rule] = c
    assert got == want


def test_mixed_rows_that_repeat(spark):
    """Rows with one id, size and source are each taken as planned, and reruns agree."""
    rng = random.Random(2)
    rows = [(i % 20, sentence(rng, 30), "en", ["a", "b", "c"][i % 3], 1, 1, 1) for i in range(90)]
    docs = spark.createDataFrame([*rows, *rows[:7]], SCHEMA)
    words = lambda d: sorted((r.doc_id, r.text) for r in d.collect())
    first = words(mixing.mixed_documents(docs))
    assert sum(len(WORD.findall(t)) for _, t in first) == sum(r.taken for r in mixing.mix_report(docs).collect())
    assert first == words(mixing.mixed_documents(docs))


def test_filters_beyond_the_broadcast_limit_still_filter(spark, monkeypatch):
    """A filter too large to broadcast is mapped from a file and rules out the same keys."""
    docs = spark.createDataFrame([(i, str(i % 40)) for i in range(60)], "did long, text string")
    keys = lambda _ids, texts: np.array([common.mixed(np.uint64(int(t))) for t in texts], np.uint64)
    counts = common.key_counts(docs, keys, 4, 2, "test-keys")
    probe = common.mixed(np.arange(4000, dtype=np.uint64))
    held = common.key_filter(counts, 4).value.contains(probe)
    monkeypatch.setattr(common, "FILTER_BYTES", 0)
    mapped = common.key_filter(counts, 4).value
    assert not mapped.whole and mapped.path
    assert (mapped.contains(probe) == held).all() and held[:20].all() and held.sum() < 200


def test_each_shard_of_key_counts_has_a_task_of_its_own(spark):
    docs = spark.createDataFrame([(i, str(i % 400)) for i in range(800)], "did long, text string")
    keys = lambda _ids, texts: np.array([common.mixed(np.uint64(int(t))) for t in texts], np.uint64)
    counts = common.key_counts(docs, keys, 24, 2, "test-shards").withColumn("file", F.input_file_name())
    shards = counts.groupBy("file").agg(F.countDistinct("shard").alias("n")).collect()
    assert len(shards) == 24 and {r.n for r in shards} == {1}
    assert counts.where("k1 IS NOT NULL").count() == 400


@pytest.mark.parametrize("by", ["written", "release"])
def test_the_drivers_garbage_goes(spark, monkeypatch, by):
    monkeypatch.setattr(common, "HEAP_SHARE", 0.0)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    runtime = jvm.java.lang.Runtime.getRuntime()
    used = lambda: (runtime.totalMemory() - runtime.freeMemory()) >> 20
    docs = spark.range(3).toDF("doc_id")
    held = gateway.new_array(gateway.jvm.byte, 200 << 20)
    before = used()
    del held
    if by == "written":
        assert common.written(docs, "test-garbage").count() == 3
    else:
        common.release(spark, docs)
    assert used() < before - 150


def test_a_heap_within_its_share_is_left_alone(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAP_SHARE", 1.0)
    assert not common.heap_grown(spark)
    assert isinstance(common.collect_driver(spark), str)


def test_jaccard_join_writes_filters_without_their_digests(spark, docs, monkeypatch):
    """Of counted digests only the filters are read again, so only they are written; what a round no longer reads isn't held."""
    made, count = [], jaccard_join.key_counts
    monkeypatch.setattr(jaccard_join, "key_counts", lambda *a, **b: made.append(count(*a, **b)) or made[-1])
    held = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before, most, write = held(), [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, what: most.append(held() if what == "components" else 0) or write(df, what))
    jaccard_join.component_table(docs).collect()
    assert len(made) == 3 and max(most) > before
    assert [d.where("filter IS NULL").count() for d in made] == [0, 0, 0] and max(most) == before + 1


def test_filters_hold_every_key():
    """Keys that were put in are found, in every shard; few others are."""
    keys = common.narrowed(np.random.default_rng(3).integers(0, 2**63, 60000).astype(np.uint64), 5)
    inside, outside = keys[:20000], np.setdiff1d(keys[20000:], keys[:20000])
    shard = common.shard_of(inside, 5)
    f = common.KeyFilter({s: np.frombuffer(common.KeyFilter.build(inside[shard == s]), np.uint8) for s in range(4)}, 5)
    assert (f.contains(inside) == (shard < 4)).all() and f.contains(outside).mean() < 0.02
    assert common.distinct(np.array([5, 1, 5, 2], np.uint64)).tolist() == [1, 2, 5] and not len(common.distinct(keys[:0]))
