"""The ten operators against brute force, exact round trips and held-out accuracy, and on awkward tables."""

import itertools
import os
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import bpe, chat, fingerprints, grouping, jaccard, langid, mpegts, packing, secret_scan, shards, simple8b, tokens
from rasterloom.llm.text import shingles, utf8

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["river", "stone", "light", "under", "seven", "paper", "winter", "garden", "motion", "silver", "bridge", "answer", "copper", "valley", "sudden", "market"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


BASE = prose(1, 120)
ROWS = [
    (1, BASE, "en", "s", 1),
    (2, BASE.replace("river", "rivers", 2), "en", "s", 1),
    (3, BASE, None, None, None),
    (4, prose(2, 150), "en", "s", 1),
    (5, "", "en", "s", 0),
    (6, None, "en", "s", None),
    (7, "!!! ??? ...", "en", None, 11),
    (8, prose(3, 40_000), "en", "s", 1),
    (9, "hi", "en", "s", 2),
    (9, "hi", "en", "s", 2),
    (10, "hi", "en", "s", 2),
    (None, BASE, "en", "s", 1),
    (11, "Ünï çödé — 漢字 😀 " * 9, "xx", "s", 1),
    (12, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "en", "s", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows, and columns whose names the operators use themselves."""
    d = spark.createDataFrame(ROWS, DOCS)
    for c in ("set_id", "component", "x", "bucket", "n_tokens", "tokens", "print_id", "part", "shard", "group_id", "__id", "__why", "__old", "why", "old", "gone_id", "comp", "u", "v", "id", "cell", "accepted", "near"):
        d = d.withColumn(c, F.lit("clash"))
    return d.repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def truth(t):
    return tokens.encoding().encode_ordinary(t) if t else []


# -- 1 fingerprints


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    out = {}
    for i in range(n):
        out.setdefault(find(i), []).append(i)
    return out


@needs_data
def test_fingerprints_match_brute_force(real):
    f = fingerprints.matched_fingerprints(real).toPandas()
    prints = [(r.block, r.sig1, r.sig2) for r in f.itertuples()]
    grams = [set(fingerprints.grams_of(*p).tolist()) for p in prints]
    c = fingerprints.Comparer(prints)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(f)), 2) if grams[i] & grams[j] and (prints[i] == prints[j] or c.scores(i, np.array([j]))[0] >= 50)]
    want = {tuple(sorted(f.doc_id[i] for i in g)) for g in components(len(f), pairs).values() if len(g) > 1}
    got = {tuple(sorted(g)) for g in f[f.group_id.notna()].groupby("group_id").doc_id.apply(list)}
    assert got == want and len(pairs) > 10
    for r in f[f.partner.notna()].itertuples():
        i, j = r.Index, f.index[f.doc_id == r.partner][0]
        assert c.scores(i, np.array([j]))[0] == r.score >= 50


def test_edit_score_against_a_plain_table():
    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            prev, d[0] = d[0], i + 1
            for j, y in enumerate(b):
                prev, d[j + 1] = d[j + 1], prev if x == y else 1 + min(d[j], d[j + 1])
        return 100 - 100 * (d[-1] * 64 // (len(a) + len(b))) // 64

    r = random.Random(4)
    letters = "ABCDEFGHabcdefgh0123+/"
    sigs = ["".join(r.choice(letters) for _ in range(r.randrange(1, 65))) for _ in range(30)]
    sigs += [s[: len(s) // 2] + "Z" + s[len(s) // 2 :][:-1] for s in sigs]
    c = fingerprints.Comparer([(3072, s, "") for s in sigs])
    short = ["".join(map(chr, fingerprints._short_runs(np.frombuffer(s.encode(), np.uint8)))) for s in sigs]
    for i in range(len(sigs)):
        js = np.arange(len(sigs))
        assert c._score(i, 0, js, 0).tolist() == [plain(short[i], short[j]) for j in js]
        for least in (30, 50, 90):
            assert (c.matches(i, js, least) == (c.scores(i, js) >= least)).all()


def test_rolling_hash_is_windowed():
    a = np.frombuffer(b"some text that is long enough to matter", np.uint8)
    whole = fingerprints.rolling(a, np.array([0, len(a)]))
    two = fingerprints.rolling(np.concatenate([a[:11], a]), np.array([0, 11, 11 + len(a)]))
    assert (two[11:] == whole).all() and (two[:11] == whole[:11]).all()


def test_fingerprints_awkward(docs, nothing):
    f = {(r["doc_id"], r["sig1"]): r for r in fingerprints.matched_fingerprints(docs).collect()}
    by = {r["doc_id"]: r for r in f.values()}
    assert by[1]["group_id"] == by[2]["group_id"] == by[3]["group_id"] == 1 and by[4]["group_id"] is None
    assert by[6]["sig1"] is None and by[5]["sig1"] == "" and by[None]["group_id"] is None
    assert by[9]["group_id"] is None, "signatures too short to compare"
    assert 32 <= len(by[8]["sig1"]) <= 64
    assert fingerprints.matched_fingerprints(docs).count() == len(ROWS)
    assert fingerprints.matched_fingerprints(nothing).count() == 0


def test_exact_copies_with_short_signatures(spark):
    line, short = "Thsh " * 600, "Edstou reinan ed for."
    texts = [line, line, "Thsh " * 599 + "Thsk ", line + "Thsh ", short, short, short[:-2] + "k.", None, None, "", ""]
    d = spark.createDataFrame([(10 + i, t) for i, t in enumerate(texts)] + [(None, line)], "doc_id long, text string")
    f = {r["doc_id"]: r for r in fingerprints.matched_fingerprints(d).collect()}
    assert len(f) == len(texts) + 1
    assert all(not len(fingerprints.grams_of(f[i]["block"], f[i]["sig1"], f[i]["sig2"])) for i in (10, 14))
    assert {i: r["group_id"] for i, r in f.items() if r["group_id"] is not None} == {10: 10, 11: 10, 14: 14, 15: 14}
    assert all(f[i]["score"] == 100 and f[i]["partner"] is None for i in (10, 11, 14, 15))


def plain_print(t):
    """Block size and both signatures, byte by byte."""
    b = t.encode()
    hits = []
    for k in range(len(b)):
        hits.append((sum((8 - j) * b[k - j] for j in range(7) if j <= k) + _xor(b, k)) & 0xFFFFFFFF)
    block = 3
    while block * 64 < len(b):
        block *= 2
    while block > 3 and sum((h + 1) % block == 0 for h in hits) < 32:
        block //= 2
    return block, *(_signature(b, hits, block * f, most) for f, most in ((1, 64), (2, 32)))


def _xor(b, k):
    out = 0
    for j in range(7):
        if j <= k:
            out ^= (b[k - j] << (5 * j)) & 0xFFFFFFFF
    return out


def _signature(b, hits, block, most):
    out, at = "", 0
    for k, h in enumerate(hits):
        if (h + 1) % 2**32 % block == 0 and len(out) < most - 1:
            out += _letter(b[at : k + 1])
            at = k + 1
    return out + (_letter(b[at:]) if at < len(b) else "")


def _letter(piece):
    h, p = 0, 1
    for x in piece:  # the polynomial hash of the piece, least power first
        h = (h + (x + 1) * p) % 2**64
        p = p * (0x9E3779B97F4A7C15 | 1) % 2**64
    h = (h + len(piece)) % 2**64
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
    return "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[(h ^ h >> 31) >> 58]


def test_signatures_are_those_of_a_plain_loop():
    texts = ["", "a", "hi there", BASE, BASE * 7, "漢字 😀 " * 60, "x" * 5000, "ab" * 2000] + [prose(k, 20 * k) for k in range(1, 25)]
    block, s1, s2 = fingerprints.signatures(*utf8(pa.array(texts)))
    for t, *got in zip(texts, block.tolist(), s1.to_pylist(), s2.to_pylist()):
        assert tuple(got) == plain_print(t), t[:40]


def test_substrings_of_many_fingerprints():
    r = random.Random(8)

    def sig(n):
        return "".join(r.choice("ABCDab01+/") * r.choice([1, 1, 1, 2, 5]) for _ in range(n))[:n]

    prints = [(3 * 2 ** r.randrange(4), sig(r.randrange(64)), sig(r.randrange(32))) for _ in range(120)]
    doc, key, before = fingerprints.substrings(np.array([p[0] for p in prints]), pa.array([p[1] for p in prints]), pa.array([p[2] for p in prints]))
    rows = [set(zip(key[doc == i].tolist(), before[doc == i].tolist())) for i in range(len(prints))]
    for i, p in enumerate(prints):
        assert {k for k, _ in rows[i]} == set(fingerprints.grams_of(*p).tolist())
        for j in range(i):  # who shares a substring shares the beginning of one
            meet = any(x == y and (a != b or a == 0) for x, a in rows[i] for y, b in rows[j])
            assert meet == bool({k for k, _ in rows[i]} & {k for k, _ in rows[j]})


def test_holders_of_a_passage_are_all_compared(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART", 8)  # several cells a substring
    passage = prose(77, 45)
    texts = [f"{prose(100 + k, 60)} {passage} {prose(300 + k, 60)}" for k in range(30)]
    texts += [prose(100 + k, 62) + " " + passage + " " + prose(300 + k, 57) for k in range(0, 30, 3)]
    f = fingerprints.matched_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    prints = [(r.block, r.sig1, r.sig2) for r in f.itertuples()]
    grams = [set(fingerprints.grams_of(*p).tolist()) for p in prints]
    c = fingerprints.Comparer(prints)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(f)), 2) if grams[i] & grams[j] and c.scores(i, np.array([j]))[0] >= 50]
    want = {tuple(sorted(f.doc_id[i] for i in g)) for g in components(len(f), pairs).values() if len(g) > 1}
    assert {tuple(sorted(g)) for g in f[f.group_id.notna()].groupby("group_id").doc_id.apply(list)} == want
    assert len({x for g in grams for x in g}) < sum(map(len, grams)), "the passage is shared"


def _random_prints(n):
    r = random.Random(11)
    sigs = ["".join(r.choice("ABCDab01") for _ in range(r.randrange(64))) for _ in range(n)]
    return [(3 * 2 ** r.randrange(3), s, s[::2]) for s in sigs]


def test_small_blocks_of_pairs_are_compared_together(monkeypatch):
    prints, made = _random_prints(200), []
    one = fingerprints.Comparer(prints)

    class Counted(fingerprints.Comparer):
        def __init__(self, prints):
            made.append(len(prints))
            super().__init__(prints)

    monkeypatch.setattr(fingerprints, "Comparer", Counted)
    r = random.Random(2)
    pairs = sorted({(r.randrange(200), r.randrange(200)) for _ in range(400)})
    rows = []
    for v in range(200):
        us = [u for u, w in pairs if w == v]
        rows += [(x, v, *prints[v if x is None else x]) for x in [None, *us]] if us else []
    t = pa.table({n: [x[k] for x in rows] for k, n in enumerate(("u", "v", "block", "sig1", "sig2"))}).append_column("cu", pa.array([x[0] for x in rows])).append_column("cv", pa.array([x[1] for x in rows]))
    got = {(x["u"], x["v"]): x["score"] for b in fingerprints._compare(20)(t.to_batches(max_chunksize=50)) for x in b.to_pylist()}
    want = {(u, v): s for u, v in pairs if (s := one.scores(v, np.array([u]))[0]) >= 20}
    assert got == want and len(want) > 20
    assert len(made) == 1, "no comparer for each block"


def test_a_cell_is_compared_in_strips(monkeypatch):
    prints, held = _random_prints(120), []
    monkeypatch.setattr(fingerprints, "STRIP", 8, raising=False)
    monkeypatch.setattr(fingerprints, "HELD", 500, raising=False)
    of_pairs = fingerprints.Comparer.of_pairs
    monkeypatch.setattr(fingerprints.Comparer, "of_pairs", lambda self, i, j: (held.append(len(i)), of_pairs(self, i, j))[1])
    t = pa.table({"cell": [1] * 120, "id": range(120), "comp": range(120), "before": pa.array([0] * 120, pa.int8()), "part": pa.array([0] * 120, pa.int32()), "block": [p[0] for p in prints], "sig1": [p[1] for p in prints], "sig2": [p[2] for p in prints]})
    got = {(x["u"], x["v"]): x["score"] for b in fingerprints._grid(20)(t.to_batches()) for x in b.to_pylist()}
    c = fingerprints.Comparer(prints)
    want = {(u, v): s for v, u in itertools.combinations(range(120), 2) if (s := of_pairs(c, np.array([u]), np.array([v]))[0]) >= 20}
    assert got == want and len(want) > 100
    assert max(held) < 500 + 8 * 120, "a task's pairs don't grow with its cells"


def test_groups_are_the_components_of_the_linked_pairs(spark):
    r = random.Random(5)
    pairs = {tuple(sorted(r.sample(range(60), 2))) for _ in range(110)}
    linked = {p for p in pairs if sum(p) % 3}
    items = spark.createDataFrame([(i, i) for i in range(60)], "id long, value long")

    def compare(rows):
        a, b = rows.filter("u is null").select(F.col("v").alias("w"), "salt", F.col("value").alias("mine")), rows.filter("u is not null")
        both = a.join(b, (a["w"] == b["v"]) & (a["salt"] == b["salt"])).filter("(mine + value) % 3 != 0")
        return both.select("u", "v", "cu", "cv", F.lit(1.0).alias("score"))

    for levels in (1, 2):
        g = grouping.Groups(items, compare)
        g.descend(spark.createDataFrame([(*p, k % levels) for k, p in enumerate(sorted(pairs))], "u long, v long, level int"))
        got = {}
        for x in g.state.collect():
            got.setdefault(x["comp"], []).append(x["id"])
        assert sorted(map(sorted, got.values())) == sorted(v for v in components(60, linked).values() if len(v) > 1)
        assert all(k == min(v) for k, v in got.items())
        assert {tuple(sorted((x["u"], x["v"]))) for x in g.links.collect()} <= linked


def test_a_hub_with_many_pairs_is_cut_into_blocks(spark):
    items = spark.createDataFrame([(i, i) for i in range(101)], "id long, value long")
    pairs = spark.createDataFrame([(i, 0, i, 0) for i in range(1, 101)], "u long, v long, cu long, cv long")
    for limit in (1 << 18, 0):  # by broadcast and by shuffle
        rows = grouping.beside(pairs, items, 100 if limit else (1 << 18) + 1, block=20).collect()
        sizes = {}
        for x in rows:
            assert (x["u"] is None and x["value"] == 0) or x["value"] == x["u"]
            sizes.setdefault(x["salt"], []).append(x["u"])
        assert len(sizes) == 5 and all(v.count(None) == 1 and len(v) < 60 for v in sizes.values()) and len(rows) == 105


# -- 2 chat


def walk(rows, conv):
    """Tokens of a conversation, read back through the ancestors' intervals."""
    leaf = next(r for r in rows if conv in r["conv_ids"])
    seq = {}
    for r in rows:
        if r["tree"] == leaf["tree"]:
            seq |= {r["start"] + k: (t, p) for k, (t, p) in enumerate(zip(r["tokens"], r["position_ids"]))}
    at = [k for a in leaf["attention"] for k in range(a["from"], a["to"])] + list(range(leaf["start"], leaf["start"] + len(leaf["tokens"])))
    return [seq[k][0] for k in at], [seq[k][1] for k in at]


def test_prefix_tree(spark):
    turns = []
    r = random.Random(2)
    for c in range(40):
        for k in range(r.randrange(1, 6)):
            turns.append((c, k, "user" if k % 2 == 0 else "assistant", f"line {r.randrange(2)} of {k}"))
    turns += [(50, 0, None, None), (50, None, "system", "first"), (50, 1, "user", ""), (51, 0, "user", "same"), (51, 0, "user", "same"), (None, 0, "user", "lost"), (52, 0, "user", prose(5, 3000))]
    random.Random(3).shuffle(turns)
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("node", F.lit(1)).withColumn("tokens", F.lit("x"))
    rows = chat.prefix_tree(df).collect()
    convs = {}
    for c, k, role, text in turns:
        if c is not None:
            convs.setdefault(c, []).append((-1 if k is None else k, role or "", text or ""))
    prefixes = set()
    for c, ts in convs.items():
        ts.sort()
        prefixes |= {tuple(t[1:] for t in ts[: i + 1]) for i in range(len(ts))}
        got, pos = walk(rows, c)
        assert got == [t for _, role, text in ts for t in truth(chat.TEMPLATE.format(role=role, text=text))]
        assert pos == list(range(len(got)))
    assert len(rows) == len(prefixes), "each shared prefix once"
    for tree in {r["tree"] for r in rows}:
        own = sorted((r for r in rows if r["tree"] == tree), key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(itertools.accumulate([0, *(len(r["tokens"]) for r in own[:-1])]))
        assert all(b["depth"] <= a["depth"] + 1 for a, b in zip(own, own[1:])), "depth first"
    assert chat.prefix_tree(df.limit(0)).count() == 0


# -- 3 and 6 tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**64 - 1), st.just(0)), max_size=700), st.sampled_from([1, 60, 128, 240]))
def test_simple8b_round_trip(ids, block):
    a = np.array(ids, np.uint64)
    bounds = np.append(np.arange(0, len(a), block), len(a)).astype(np.int64) if len(a) else np.array([0])
    words, size = simple8b.pack(a, bounds)
    assert (simple8b.unpack(words, np.cumsum(size) - size, len(a), block) == a).all()
    i = 0
    while i < len(words):  # only known selectors; what an escape carries is no word
        s = int(words[i] >> np.uint64(60))
        i += 2 if s == simple8b.ESCAPE else 1
    assert i == len(words)


def test_token_words_awkward(docs, nothing):
    d = simple8b.token_words(docs).withColumn("ids", simple8b.unpacked(F.struct("n_tokens", "offsets", "words"))).collect()
    want = sorted((str(r[0]), truth(r[1])) for r in ROWS)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in d) == want
    assert all(len(r["offsets"]) == -(-r["n_tokens"] // simple8b.BLOCK) for r in d)
    assert simple8b.token_words(nothing).count() == 0


def test_bpe_is_exact(docs, nothing):
    d = bpe.encode_documents(docs).withColumn("text", bpe.decoded(F.col("tokens"))).collect()
    assert sorted((str(r["doc_id"]), list(r["tokens"])) for r in d) == sorted((str(r[0]), truth(r[1])) for r in ROWS)
    assert sorted(r["text"] for r in d) == sorted(r[1] or "" for r in ROWS)
    assert bpe.encode_documents(nothing).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["the", " ", "  ", "\n", "é", "漢", "'s", "123", " a", "!", "\t", "word ", "don't ", "x" * 30]), max_size=60), st.integers(2, 5))
def test_bpe_joins_are_repaired(parts, bits):
    text = "".join(parts)
    data, off = utf8(pa.array([text, text[::-1]]))
    s, first = bpe.boundaries(data, off, window=3, bits=bits)
    raw, cuts = data.tobytes(), [*s.tolist(), len(data)]
    c = bpe.Chunks(tokens.VOCABULARY, kept=64)
    for k, t in enumerate((text, text[::-1])):
        chunks = [raw[cuts[i] : cuts[i + 1]] for i in range(first[k], first[k + 1])]
        assert b"".join(chunks).decode() == t and c.document(chunks).tolist() == truth(t)


def test_equal_chunks_are_encoded_once():
    c = bpe.Chunks(tokens.VOCABULARY)
    made = []
    make = c.make
    c.make = lambda t: made.append(t) or make(t)
    data, off = utf8(pa.array([BASE, BASE + " more of it"]))
    s, first = bpe.boundaries(data, off, bits=6)
    raw, cuts = data.tobytes(), [*s.tolist(), len(data)]
    for k in (0, 1):
        c.document([raw[cuts[i] : cuts[i + 1]] for i in range(first[k], first[k + 1])])
    assert len(made) <= first[1] + 2


# -- 4 language


@needs_data
def test_language_on_rows_that_were_not_in_training(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 2 = 0")
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 2 = 1")
    model = langid.train(d, per_language=60)
    r = langid.identify(held, model).join(held.select("doc_id", F.col("lang").alias("want")), "doc_id").toPandas()
    assert (r.lang == r.want).mean() > 0.98 and r.accepted.mean() > 0.99
    junk = spark.createDataFrame([(1, "0x9f 7f7f qzxj kqjz zzxq wqkj xjqz qqqx jjzq vvkq xqzw"), (2, None), (3, ""), (4, "12 34 !!")], "doc_id long, text string")
    assert [x["accepted"] for x in langid.identify(junk, model).orderBy("doc_id").collect()] == [False] * 4


def spelled(t):
    """Lower-case letters, and one space for each run of others, by the standard library."""
    return re.sub(" +", " ", "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in t.lower()))


def bucket(gram, buckets=langid.BUCKETS):
    v = 0
    for c in gram:
        v = (v * 0x9FB21C651E98DF25 + ord(c) + 1) % 2**64
    v = (v + len(gram)) % 2**64
    v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    v = (v ^ v >> 27) * 0x94D049BB133111EB % 2**64
    return (v ^ v >> 31) >> 64 - 16


def test_language_scores_are_plain_sums(docs):
    m = langid.train(docs)
    texts = ["River stone, light!", "", None, "Üñd so — weiter 漢字", "x", "!", "क्षेत्र 😀 end 𝔘𝔫", " a  b "]
    got, n = langid.scores(m, pa.array(texts))
    for k, t in enumerate(texts):
        b = spelled(t or "")
        grams = [b[i : i + size] for size in langid.NS for i in range(len(b) - size + 1)]
        assert n[k] == len(grams)
        assert got[k] == pytest.approx(np.sum([m.matrix[bucket(g)].astype(float) for g in grams], axis=0) if grams else np.zeros(len(m.languages)))


def test_language_counts_are_plain_counts(spark):
    rows = [(i, prose(i, 30) if i % 2 else prose(i, 30)[::-1], "ab"[i % 2]) for i in range(40)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {x: np.zeros(langid.BUCKETS) for x in "ab"}
    for _, t, lang in rows:
        b = spelled(t)
        for size in langid.NS:
            for i in range(len(b) - size + 1):
                counts[lang][bucket(b[i : i + size])] += 1
    assert m.languages == ["a", "b"] and m.slack == langid.SLACK, "too few texts to calibrate on"
    for k, c in enumerate(counts.values()):
        assert np.allclose(m.matrix[:, k], np.log((c + langid.ALPHA) / (c.sum() + langid.ALPHA * langid.BUCKETS)), atol=1e-5)


@needs_data
def test_language_refuses_made_junk_and_keeps_clean_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(d.filter("doc_id % 2 = 0"), per_language=100)
    held = d.filter("doc_id % 2 = 1").toPandas().text
    r = random.Random(1)
    junk = langid.junk_of(pa.array(held)).to_pylist()  # their own letters in random order
    junk += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)) for _ in range(100)]
    junk += ["".join(r.choice("0123456789abcdef") for _ in range(600)) for _ in range(100)]
    _, _, grams, kept = langid.decide(model, pa.array(held))
    assert model.slack != langid.SLACK and kept.mean() >= 0.99
    _, _, grams, kept = langid.decide(model, pa.array(junk))
    assert kept[grams >= langid.LONG].mean() <= 0.01


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST", langid.BUCKETS * 3 * 4)
    rows = [(i, "some text", f"l{i}") for i in range(4)]
    with pytest.raises(ValueError, match="languages"):
        langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language_awkward(docs, nothing):
    r = langid.identify(docs).collect()
    by = {x["doc_id"]: x for x in r}
    assert len(r) == len(ROWS) and by[1]["accepted"] and by[8]["accepted"]
    assert not any(by[k]["accepted"] for k in (5, 6, 7)) and by[6]["lang"] == "und"
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (5, 6, 7)").count() == 0 and kept.filter("doc_id = 9").count() == 2
    assert langid.identify(nothing).count() == 0 and langid.accepted(nothing).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {x["lang"] for x in langid.identify(unlabelled).collect()} == {"und"}


# -- 5 Jaccard


def grams(t, n=jaccard.GRAM):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_shingles_are_those_of_a_plain_loop():
    texts = [r[1] for r in ROWS if r[1] is None or len(r[1]) < 5000]
    g, at = shingles(*utf8(pa.array(texts, pa.string()), lower=True), 2)
    sets = [set(g[i:j].tolist()) for i, j in zip(at[:-1], at[1:])]
    for a, b in itertools.product(range(len(texts)), repeat=2):
        assert len(sets[a] & sets[b]) == len(grams(texts[a]) & grams(texts[b]))


def test_prefixes_are_shortened_until_the_recall():
    d = jaccard.shortened(0.6, 40, 8, 0.95)
    assert jaccard.recall_at(d, 0.6, 40) >= 0.95 > jaccard.recall_at(d + 1, 0.6, 40)


def test_queries_end_at_levels_of_their_own(spark):
    base = {k: [f"w{k}x{i}" for i in range(400)] for k in range(3)}
    r = random.Random(3)

    def copy(k, share):
        return " ".join(w if r.random() > share else f"n{r.randrange(10**9)}" for w in base[k])

    texts = [copy(0, 0.004) for _ in range(40)] + [copy(1, 0.004) for _ in range(6)] + [copy(2, 0.0), copy(2, 0.06)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sketch, groups = jaccard.search(d)
    ended = groups.state.join(sketch.select("set_id", "doc_id"), F.col("id") == F.col("set_id")).toPandas().set_index("doc_id").stop
    assert set(ended[range(40)]) == {8} and set(ended[range(40, 46)]) in ({6}, {7}) and set(ended[[46, 47]]) == {5}
    assert {tuple(x["doc_ids"]) for x in jaccard.near_groups(d).collect()} == {tuple(range(40)), tuple(range(40, 46)), (46, 47)}


def test_longest_matches_in_the_sorted_tries(spark):
    r = random.Random(9)
    paths = {i: [(r.randrange(2), [r.randrange(2) for _ in range(3)]) for _ in range(3)] for i in range(24)}
    bits = jaccard.bits_of(5, 8)
    rows = [(i, i, 9, [n + 10 * t for t, (n, _) in enumerate(p)], [sum(x << bits * (2 - k) for k, x in enumerate(d)) for _, d in p]) for i, p in paths.items()]
    sketch = spark.createDataFrame(rows, "doc_id long, set_id long, n_grams int, nodes array<long>, deep array<long>")
    got = {(x["set_id"], x["node"] // 10): x["match"] for x in jaccard.tries(sketch, 5, 8).collect()}
    for i, p in paths.items():
        for t, (n, d) in enumerate(p):
            same = [next((k for k in range(3) if q[t][1][k] != d[k]), 3) for j, q in paths.items() if j != i and q[t][0] == n]
            assert got.get((i, t)) == (5 + max(same) if same else None)


@needs_data
def test_near_groups_match_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = d.toPandas()
    sets = [grams(t) for t in p.text]
    post = {}
    for i, s in enumerate(sets):
        for x in s:
            post.setdefault(x, []).append(i)
    cand = {q for v in post.values() for q in itertools.combinations(v, 2)}
    pairs = [(i, j) for i, j in cand if len(sets[i] & sets[j]) >= jaccard.THRESHOLD * len(sets[i] | sets[j])]
    got = {x: k for k, r in enumerate(jaccard.near_groups(d).collect()) for x in r["doc_ids"]}
    found = sum(p.doc_id[i] in got and got[p.doc_id[i]] == got.get(p.doc_id[j]) for i, j in pairs)
    assert found >= jaccard.RECALL * len(pairs) and len(pairs) > 100
    linked = {p.doc_id[i] for q in pairs for i in q}
    assert set(got) <= linked, "clean documents are in no group"


def test_near_awkward(docs, nothing):
    r = jaccard.near_groups(docs).collect()
    groups = {x["group_id"]: x["doc_ids"] for x in r}
    assert groups == {1: [1, 2, 3], 9: [9, 10]}
    link = next(x for x in r if x["group_id"] == 1)["pairs"]
    assert all(p["jaccard"] >= jaccard.THRESHOLD for p in link)
    for p in link:
        a, b = (grams(next(x[1] for x in ROWS if x[0] == k)) for k in (p["a"], p["b"]))
        assert p["jaccard"] == pytest.approx(len(a & b) / len(a | b))
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = [x[0] for x in kept.select("doc_id").collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 4, 5, 6, 7, 8, 9, None, 11, 12]))
    assert jaccard.near_groups(nothing).count() == 0 and jaccard.first_of_each(nothing).count() == 0


def test_common_values_match_plain_loops():
    r = random.Random(1)
    for m in (2, 3, 20, 60):
        sets = [r.sample(range(80), r.randrange(1, 40)) for _ in range(m)]
        flat, size = np.array([x for s in sets for x in s], np.int64), np.array([len(s) for s in sets])
        for split in (0, m // 2):
            got, left, right = jaccard.common(flat, size, split), sets[: split or m], sets[split:]
            assert got.shape == (len(left), len(right))
            assert all(split == 0 and i == j or got[i, j] == len(set(a) & set(b)) for i, a in enumerate(left) for j, b in enumerate(right))


def test_no_link_is_left_out(spark):
    """Two tight classes whose searches end deep but that are linked with each other, loosely linked texts, copies, repeated ids, texts without words."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    far = [f"n{i}" if i < 36 else w for i, w in enumerate(base)]  # about 0.78 similar

    def copy(words, share):
        return " ".join(w if r.random() > share else f"m{r.randrange(10**9)}" for w in words)

    texts = [copy(base, 0.003) for _ in range(25)] + [copy(far, 0.003) for _ in range(25)]
    texts += [copy(base[:150] + [f"{k}x{i}" for i in range(20)], 0.02) for k in "abcd"] + [texts[3].upper(), texts[3] + " !", prose(5, 90), None, "", "?!"]
    rows = [*enumerate(texts), (3, texts[3]), (56, texts[56]), (None, texts[0])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [grams(t) for t in texts]
    score = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in itertools.permutations(range(len(texts)), 2) if sets[i] and sets[j]}
    linked = [p for p, s in score.items() if s >= jaccard.THRESHOLD]
    got = jaccard.near_links(d).toPandas().set_index("doc_id")
    assert sorted(got.index) == list(range(len(texts)))
    assert all(got.n_links[i] == sum(a == i for a, _ in linked) for i in got.index) and len(linked) > 2400
    assert {tuple(sorted(g.index)) for _, g in got.groupby("class_id")} == {tuple(sorted(g)) for g in components(len(texts), linked).values()}
    assert all(k == min(g.index) for k, g in got.groupby("class_id"))
    for i in got.index:
        others = [(-score[i, j], j) for a, j in linked if a == i and sets[j] != sets[i]]
        if others:
            assert got.partner[i] == min(others)[1] and got.jaccard[i] == pytest.approx(-min(others)[0])
        else:
            assert np.isnan(got.partner[i]) and np.isnan(got.jaccard[i])
    # the same if a class is dealt to many parts, and less if only pairs of different groups were compared, as in near_groups
    sketch, groups = jaccard.search(d.filter("doc_id is not null"))
    copies = sketch.select("doc_id", F.col("set_id").alias("id")).distinct().groupBy("id").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"))
    many = jaccard.links(groups, copies, jaccard.THRESHOLD, cell=20_000).join(copies, "id").toPandas()
    assert all(got.n_links[x.doc] == x.n + x.copies - 1 and got.partner[x.doc] == x.partner for x in many.itertuples()) and len(many) > 30
    assert groups.links.count() < len(linked) // 4


def test_the_forest_is_searched_in_few_rounds(spark, monkeypatch):
    """Pairs just under the threshold meet at every level; each round of comparisons leaves plans in the driver."""
    rounds, step = [], grouping.Groups.step
    monkeypatch.setattr(grouping.Groups, "step", lambda self, pairs, n, level: rounds.append(n) or step(self, pairs, n, level))
    texts = [" ".join(f"{k}{c if i >= 75 else ''}w{i}" for i in range(100)) for k in range(40) for c in "ab"]
    _, groups = jaccard.search(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert groups.state.isEmpty() and sum(rounds) >= 40 and len(rounds) <= 3


def test_near_links_awkward(docs, nothing):
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard.near_links(docs).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 9: (9, 1), 10: (9, 1), **{k: (k, 0) for k in (4, 5, 6, 7, 8, 11, 12)}}
    assert jaccard.near_links(nothing).count() == 0


# -- 7 shards


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=9), st.integers(1, 5))
def test_smallest_capacity_is_that_of_all_partitions(sizes, k):
    total = sum(sizes)
    if not total:
        return
    best = min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes)))) for c in itertools.combinations_with_replacement(range(len(sizes) + 1), k - 1))
    ends = np.unique(np.cumsum(sizes))
    low, high = max(max(sizes), -(-total // k)), -(-total // k) + max(sizes)
    cap, at = shards.smallest(ends, total, k, low, high)
    assert cap == best and len(at) <= k and at[-1] == total
    window = [e for e in ends if any(j * (low - max(sizes)) <= e <= j * high for j in range(1, k + 1))]
    assert shards.smallest(np.unique([*window, total]), total, k, low, high) == (cap, at)


def test_shards_awkward(docs, nothing):
    r = sorted(shards.minimax_shards(docs, F.octet_length("text"), ["source", "doc_id"], 3).collect(), key=lambda x: (x["source"] or "", -1 if x["doc_id"] is None else x["doc_id"]))
    assert len(r) == len({(x[3], x[0]) for x in ROWS}) and r[0]["source"] is None
    assert [x["end"] for x in r] == list(itertools.accumulate(x["size"] for x in r))
    assert [x["shard"] for x in r] == sorted(x["shard"] for x in r) and max(x["shard"] for x in r) <= 2
    sums = {}
    for x in r:
        sums[x["shard"]] = sums.get(x["shard"], 0) + x["size"]
    assert max(sums.values()) <= r[0]["capacity"] == max(x["size"] for x in r)
    assert shards.minimax_shards(nothing, F.octet_length("text"), ["source", "doc_id"]).count() == 0
    empty = docs.filter("doc_id = 5")
    assert shards.minimax_shards(empty, F.octet_length("text"), ["doc_id"]).first()["shard"] == 0


# -- 8 transport streams


def test_streams_round_trip():
    for n in range(0, 40):
        data = prose(n, 900).encode()
        got = mpegts.parse(mpegts.stream_of(data, n))
        if n % 7 != 3:
            assert b"".join(r["payload"] for r in got) == data and all(r["complete"] for r in got)
        else:
            assert sum(r["jumps"] for r in got) == 1 and not all(r["complete"] for r in got)
    video = [r for r in got if r["pid"] == 0x101]
    assert [r["random_access"] for r in got if r["pid"] == 0x102] == [False] * sum(r["pid"] == 0x102 for r in got)
    assert all(r["pts"] - r["dts"] == 7200 for r in video) and any(r["random_access"] for r in video)


def test_stream_details():
    assert mpegts.crc32_mpeg(b"123456789") == 0x0376E6E7
    t = (1 << 33) - 2
    assert mpegts._read_stamp(mpegts._stamp(2, t)) == t
    m = mpegts.Muxer()
    m.tables(7, 0x30, [(0x1B, 0x50)])
    m.pes(0x50, 0xE0, b"x" * 400, None, bounded=False)
    raw = m.bytes()
    (r,) = mpegts.parse(b"junk" + raw)
    assert (r["program"], r["pts"], r["payload"]) == (7, None, b"x" * 400)
    broken = bytearray(raw)
    broken[188 + 20] ^= 1
    assert mpegts.parse(bytes(broken)) == [], "a table with a wrong CRC lists nothing"
    assert mpegts.parse(b"") == [] and mpegts.parse(b"G" * 50) == []


def packet(head, load, adaptation=b""):
    """A transport packet from its four header bytes in hex; stuffed in front of the payload."""
    field = adaptation
    if (gap := 184 - len(load) - len(field)) > 0 and int(head[6], 16) & 2:
        field = bytes([len(adaptation) + gap - 1]) + (adaptation[1:] or b"\0") + b"\xff" * (gap - (0 if adaptation else 2))
    return (bytes.fromhex(head) + field + load).ljust(188, b"\xff")


PAT = bytes.fromhex("00 00b00d0001c100000001f000 2ab104b2".replace(" ", ""))  # program 1 in PID 0x1000, as a common muxer writes it
PMT = bytes.fromhex("00 02b0120001c10000e100f000 1be100f000 15bd4d56".replace(" ", ""))  # H.264 in PID 0x100


def test_a_stream_written_by_hand():
    first = bytes.fromhex("000001e0 0000 808005 210007d861".replace(" ", "")) + b"A" * 100  # 126,000 ticks: 1.4 s
    second = bytes.fromhex("000001e0 0000 80c00a 310007ef5d 110007d861".replace(" ", "")) + b"B" * 20
    raw = packet("47400010", PAT) + packet("47500010", PMT) + packet("47410030", first, bytes([1, 0x40])) + packet("47410031", second)
    a, b = mpegts.parse(raw)
    assert (a["program"], a["pid"], a["stream_type"], a["packet"], a["pts"], a["dts"], a["random_access"], a["payload"]) == (1, 0x100, 0x1B, 2, 126_000, 126_000, True, b"A" * 100)
    assert (b["pts"], b["dts"], b["random_access"], b["payload"]) == ((0x07 >> 1) << 15 | 0xEF << 7 | 0x5D >> 1, 126_000, False, b"B" * 20)


@pytest.mark.parametrize("kind", [0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF])
def test_packets_without_an_optional_header(kind):
    load = bytes(range(200, 250))
    (r,) = mpegts.parse(packet("47400010", PAT) + packet("47500010", PMT) + packet("47410030", bytes([0, 0, 1, kind, 0, 50]) + load))
    assert (r["payload"], r["pts"], r["complete"]) == (load, None, True)


def test_versions_of_a_program_map():
    def pmt(body, current=1, version=0):
        s = bytes([2, 0xB0, len(body) + 13, 0, 1, 0xC0 | version << 1 | current, 0, 0, 0xE1, 0, 0xF0, 0]) + body
        return b"\0" + s + mpegts.crc32_mpeg(s).to_bytes(4, "big")

    pes = bytes.fromhex("000001c0 0004 800000".replace(" ", "")) + b"x"
    unit = [packet(f"474100{0x30 + k:02x}", pes) for k in range(4)]
    tables = [pmt(bytes.fromhex(x), c, v) for x, c, v in (("0fe100f000", 1, 0), ("1be100f000", 0, 1), ("03e100f000", 1, 1), ("03e101f000", 1, 2))]
    maps = [packet(f"475000{0x10 + k:02x}", t) for k, t in enumerate(tables)]
    raw = packet("47400010", PAT) + unit[0] + b"".join(m + u for m, u in zip(maps, [*unit[1:], packet("47410034", pes)]))
    assert [r["stream_type"] for r in mpegts.parse(raw)] == [0x0F, 0x0F, 0x0F, 0x03], "the second isn't current, the fourth ends the stream"


def test_streams_awkward(spark):
    rows = [(1, mpegts.stream_of(prose(1, 300).encode(), 1)), (1, mpegts.stream_of(prose(1, 300).encode(), 1)), (2, None), (None, mpegts.stream_of(b"abc", 2)), (3, b""), (4, b"no stream"), (5, mpegts.stream_of(prose(2, 60_000).encode(), 1))]
    d = spark.createDataFrame(rows, "page_id long, media binary").withColumn("pid", F.lit(1)).withColumn("seq", F.lit("x"))
    r = mpegts.elementary_packets(d, "page_id", "media").collect()
    assert {x["page_id"] for x in r} == {1, 5, None}
    assert b"".join(bytes(x["payload"]) for x in sorted((x for x in r if x["page_id"] == 5), key=lambda x: x["seq"])) == prose(2, 60_000).encode()
    assert mpegts.elementary_packets(d.limit(0), "page_id", "media").count() == 0


# -- 9 secrets


@settings(max_examples=80, deadline=None)
@given(st.text("abcdef0123456789XYZ+/", min_size=1, max_size=60), st.integers(1, 30))
def test_window_entropy_against_fresh_counts(s, w):
    from collections import Counter

    best = max(-sum(c / n * np.log2(c / n) for c in Counter(part).values()) for part in [s[i : i + w] for i in range(max(1, len(s) - w + 1))] for n in [len(part)])
    assert secret_scan.window_entropy(s, w)[0] == pytest.approx(best, abs=1e-6)


def test_secrets_awkward(docs, nothing):
    r = secret_scan.scan(docs).collect()
    assert [(x["doc_id"], x["value"], x["class"]) for x in r] == [(12, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "hex")]
    text = ROWS[13][1].encode()
    assert text[r[0]["start"] : r[0]["end"]].decode() == r[0]["value"]
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    by = {x["doc_id"]: x for x in clean.collect()}
    assert by[12]["text"] == 'token = "<SECRET>" end' and by[12]["n_chars"] == len(by[12]["text"])
    assert by[1]["text"] == BASE and by[1]["n_chars"] == 1 and by[6]["text"] is None
    assert secret_scan.scan(nothing).count() == 0 and secret_scan.redact(nothing).count() == 0


def test_allow_list_and_classes(spark):
    t = "averylongplainwordthatgoesonandon 12345678901234567890123 aaaaaaaaaaaaaaaaaaaaaaaa path/to/some/other/file/here deadBEEF0123cafeBABE4567 Zx9+kQ2/mB7=pL4_tR8-wN1"
    d = spark.createDataFrame([(1, t), (2, "ab" + "é" + "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")], "doc_id long, text string")
    r = {(x["doc_id"], x["value"]): x for x in secret_scan.scan(d).collect()}
    assert {v for i, v in r if i == 1} == {"Zx9+kQ2/mB7=pL4_tR8-wN1"} | {v for i, v in r if v.startswith("deadBEEF")}
    assert r[(2, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]["start"] == 4, "bytes, not characters"
    assert secret_scan.find(*utf8(pa.array(["24be64439e3e49cf46b2", "d7c90f3602a3d0b907ff"]))) and len(secret_scan.find(*utf8(pa.array(["24be64439e3e49cf46b2", "d7c90f3602a3d0b907ff"])))) == 2


def test_secrets_glued_or_cut():
    r = random.Random(5)

    def lost(make, n=300):
        return n - len(secret_scan.find(*utf8(pa.array([make() for _ in range(n)]))))

    def hexes(n):
        return "".join(r.choice("0123456789abcdef") for _ in range(n))

    for before in ("", "key=", "token=", "sk-", "id-", "API_KEY=", "some/path/"):
        assert lost(lambda: before + hexes(40)) == 0, before  # noqa: B023
        assert lost(lambda: before + hexes(40).upper()) == 0, before  # noqa: B023
    for cuts in ((8, 4, 4, 4, 12), (10, 10, 10, 10), (4,) * 10):
        assert lost(lambda: "-".join(map(hexes, cuts))) <= 3  # noqa: B023
    t = "é key=24be64439e3e49cf46b2d7c90f3602a3d0b907ff;"
    assert secret_scan.find(*utf8(pa.array(["", t]))) == [(1, 3, 47, "hex", t[2:-1], secret_scan.window_entropy(t[6:-1])[0])]
    assert not secret_scan.find(*utf8(pa.array(["some_module/SomeClassName-2026_11_25 order=1234567890123456 -" + "-" * 5000 + "word" * 5000 + "=a7"])))


def test_recall_of_random_keys_by_class_and_length():
    r = random.Random(6)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    signs = {"hex": "0123456789abcdef", "base32": upper + "234567", "upper": upper + "0123456789", "lower": lower + "0123456789", "base62": upper + lower + "0123456789", "base64": upper + lower + "0123456789+/", "url": upper + lower + "0123456789-_"}
    for name, own in signs.items():
        for n in (20, 24, 32, 40):
            keys = ["".join(r.choices(own, k=n)) for _ in range(1000)]
            keys = [k for k in keys if not any(re.fullmatch(a, k) for a in secret_scan.ALLOW)]
            assert len(secret_scan.find(*utf8(pa.array(keys)))) >= 0.985 * len(keys), (name, n)
    keys = ["AKIA" + "".join(r.choices(signs["upper"], k=16)) for _ in range(1000)]
    assert len(secret_scan.find(*utf8(pa.array(keys)))) >= 980
    assert not secret_scan.find(*utf8(pa.array(["some_module/SomeClassName2026-11-25 addListenerEndedAtLast2 one-2026-11-25-two-release"])))


# -- 10 packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=9, unique=True), st.integers(1, 4), st.data())
def test_buckets_are_optimal(lengths, k, data):
    lengths = np.array(sorted(lengths))
    counts = np.array([data.draw(st.integers(1, 9)) for _ in lengths])

    def padding(bounds):
        return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))

    best = min(padding((*c, lengths[-1])) for c in itertools.combinations_with_replacement(lengths.tolist(), k - 1))
    got = packing.boundaries(lengths, counts, k)
    assert len(got) <= k and got[-1] == lengths[-1] and padding(got) == best


def test_costs_beyond_64_bits_are_exact():
    lengths, counts = np.array([1, 2, 10**9, 10**9 + 1, 3 * 10**9]), np.array([10**12, 1, 10**10, 10**10, 1])
    for k in (1, 2, 3, 4, 5):
        want = min(itertools.combinations(lengths.tolist()[:-1], k - 1), key=lambda c: sum(int(n) * (min(b for b in (*c, int(lengths[-1])) if b >= v) - v) for v, n in zip(lengths.tolist(), counts.tolist())))
        assert packing.boundaries(lengths, counts, k) == [*want, 3 * 10**9]
    small, many = np.arange(1, 60) ** 2, np.arange(60, 1, -1)
    bounds = packing.boundaries(small, many, 7)
    assert packing.boundaries(small * 2**40, many * 2**20, 7) == [b * 2**40 for b in bounds], "the same in Python's integers"


def test_bounds_of_long_lengths_are_optimal(spark):
    n = np.random.default_rng(2).integers(1, 60_000, 300)
    d = spark.createDataFrame([(i, int(x)) for i, x in enumerate(n)], "doc_id long, size long")
    got = packing.pack(d, buckets=6, length=F.col("size")).toPandas()
    lengths, counts = np.unique(n, return_counts=True)
    cost = [0, *[10**12] * len(lengths)]
    for _ in range(6):  # plainly, every split
        cost = [min([cost[j], *(cost[i] + int(((lengths[j - 1] - lengths[i:j]) * counts[i:j]).sum()) for i in range(j))]) for j in range(len(cost))]
    assert got.bucket_len.max() == n.max() and got.padding.sum() == cost[-1] and set(got.bucket_len) <= set(lengths)


def test_packing_awkward(docs, nothing):
    r = packing.pack(docs, buckets=4, budget=600, lanes=3).collect()
    assert sorted((str(x["doc_id"]), x["n_tokens"]) for x in r) == sorted((str(x[0]), len(truth(x[1]))) for x in ROWS)
    batches = {}
    for x in r:
        assert x["padding"] == x["bucket_len"] - x["n_tokens"] >= 0
        batches.setdefault((x["bucket"], x["batch"]), []).append(x)
    for (bucket, batch), own in batches.items():
        assert sorted(x["slot"] for x in own) == list(range(len(own)))
        assert len(own) * own[0]["bucket_len"] <= 600 or len(own) == 1
        full = max(1, 600 // max(own[0]["bucket_len"], 1))
        assert len(own) == full or batch == max(b for q, b in batches if q == bucket)
    assert packing.pack(nothing).count() == 0
