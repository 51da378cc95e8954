"""Operators 11 to 13 against brute force, on hard rows and on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.llm import merkle, minhash, ordered, trie

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def trie_truth(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest()), (r or "", x or "")))
    convs = {c: [y for _, y in sorted(own)] for c, own in convs.items()}
    members, ends, kids = {}, {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = convs.get(c - c % 20, [])[:h] + own[h:]
        ends.setdefault(tuple(seq), []).append(c)
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = (len(members[k]) - 1) * len(re.findall(WORD, k[-1][1]) if k else ()) + sum(saved[x] for x in below)
        listed = hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below), leaves[k], saved[k], listed))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks():
    draw = random.Random(1)
    rows = []
    for c in [*range(120), 200, 219, 1000003, 1000019]:
        if draw.random() < 0.85:
            rows += [(c, draw.choice([t, t, t, None, 2]), draw.choice(["user", "assistant", None]), draw.choice(["a b", "hello  there\n you", None, ""])) for t in range(draw.randint(1, 9))]
    return rows + [(None, 1, "user", "x"), (7, 1, "user", "a b"), (7, 1, "user", "a b")] + [(400 + i, 1, "user", "same end") for i in range(60)]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie(spark, talks, monkeypatch):
    want = trie_truth(talks)
    df = spark.createDataFrame(talks, SCHEMA).repartition(5)
    assert rows_of(trie.trie(df)) == want
    monkeypatch.setattr(ordered, "BLOCK", 3)  # blocks of places, and end lists that are streams
    monkeypatch.setattr(trie, "LIST_BLOCK", 4)
    clash = df.select(F.lit("x").alias("TEXT"), "*", F.lit(1).alias("k1"), F.lit(2).alias("depth"))
    assert rows_of(trie.trie(clash)) == want
    assert trie.trie(df.where("false")).count() == 0


def test_trie_of_long_conversations(spark):
    rows = [(c, i, "user", f"long {i % 3}") for c in (300, 301) for i in range(5000)] + [(320, 1, "user", "x " * 200_000)]
    got = rows_of(trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(6)))
    assert got == trie_truth(rows)


def test_trie_of_a_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert rows_of(trie.trie(df)) == trie_truth([tuple(r) for r in df.collect()])


def digest(s):
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def merkle_truth(rows, tampered):
    coded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    leaf = lambda r, change=lambda t: t: digest("".join(map(coded, (r[0], r[1], r[2], r[3], change(r[4])))))

    def levels(row):
        out = [row]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def way(tree, i):
        for row in tree[:-1]:
            run = row[i // 8 * 8 : i // 8 * 8 + 8]
            yield run[: i % 8], run[i % 8 + 1 :]
            i //= 8

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in groups[g]]) for g in names]
    top = levels([t[-1][0] for t in trees])
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = [*way(trees[k], i), *way(top, k)]
            end = leaf(r, lower) if r[0] is not None and tampered(r[0]) else leaf(r)
            for before, after in path:
                end = digest("".join([*before, end, *after]))
            yield r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], digest("".join(x for a, b in path for x in a + b)), end, end == top[-1][0]


THIRD = lambda i: zlib.crc32(str(i).encode()) % 3 == 0
THIRD_COLUMN = lambda i: F.crc32(i.cast("string").cast("binary")) % 3 == 0
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest(spark):
    rows = [(i, "s", "en", 3, f"Text {i}") for i in range(1200)] + [(i, None, f"l{i % 11}", None, "É" * (i % 4)) for i in range(80)]
    rows += [(5, "s", "de", 1, "A"), (None, "s", None, 1, None), (None,) * 5, (None,) * 5, (7, "s", "one", 1, "X y" * 50_000), (3, "s", "en", 3, "Text 3"), (3, "s", "en", 3, "other")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    want = sorted(merkle_truth(rows, THIRD), key=str)
    assert rows_of(merkle.manifest(df, tampered=THIRD_COLUMN)) == want
    got = merkle.manifest(df.select(F.lit("x").alias("TEXT"), "*", F.lit(1).alias("leaf"), F.lit("t").alias("tree"))).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    assert merkle.manifest(df.where("false")).count() == 0
    for few in (rows[:1], rows[:8], rows[:9], rows[1200:1202]):
        assert rows_of(merkle.manifest(spark.createDataFrame(few, DOCS), tampered=THIRD_COLUMN)) == sorted(merkle_truth(few, THIRD), key=str)


def test_manifest_of_a_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    assert rows_of(merkle.manifest(df, tampered=THIRD_COLUMN)) == sorted(merkle_truth([tuple(r) for r in df.collect()], THIRD), key=str)


def shingle_set(text):
    w = re.findall(WORD.encode(), re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(b" ".join(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([b" ".join(w)] if w else [])


def near_truth(rows):
    own = [shingle_set(t) for _, t in rows]
    nodes = list({s for s in own if s})
    root = {s: s for s in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    posted = {}
    for i, s in enumerate(nodes):
        for g in s:
            posted.setdefault(g, []).append(i)
    for i, s in enumerate(nodes):
        for j, k in Counter(j for g in s for j in posted[g] if j < i).items():
            if 100 * k >= 80 * (len(s) + len(nodes[j]) - k):
                root[find(s)] = find(nodes[j])
    best = {}
    for (d, _), s in zip(rows, own):
        if s and d is not None:
            best[find(s)] = min(best.get(find(s), d), d)
    for (d, _), s in zip(rows, own):
        c = best.get(find(s)) if s else d
        yield d, len(s), c, d == c


@pytest.fixture(scope="module")
def copies():
    draw = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    base = [draw.choice(words) for _ in range(120)]
    rows = []
    for i in range(300):  # near copies of one text, many of them just under the similarity
        own = list(base)
        for _ in range(draw.randint(0, 9)):
            own[draw.randrange(len(own))] = draw.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(400, None), (401, None), (402, " \t\n"), (403, ""), (None, " ".join(base)), (None, None)]
    return rows + [(5, "a b"), (6, "A  b\n"), (7, "word " * 5000), (8, "word " * 4000), (9, "a b c d e f g h"), (10, "a b c d e f g h i"), (11, "É b"), (12, "é b"), (9, "a b c d e f g h")]


@pytest.mark.parametrize("members", [1024, 16])
def test_near_documents(spark, copies, monkeypatch, members):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", members)  # one block, and many that meet in pairs
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(4)
    clash = df.select(F.lit("x").alias("TEXT"), "*", F.lit(1).alias("node"), F.lit(2).alias("n"))
    assert rows_of(minhash.near_duplicates(clash)) == sorted(near_truth(copies), key=str)
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_near_documents_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "`doc.id` long, text string"), id_col="doc.id")
    assert rows_of(got) == sorted(near_truth(rows), key=str) and got.columns[0] == "doc.id"


def test_circle_is_one_permutation_under_shifts():
    circle = minhash._circle()
    assert len(set(circle[:, 0].tolist())) == minhash.SPACE and (circle[minhash.SPACE - 1, 1:] == circle[0, :-1]).all() and (circle[5, 1:] == circle[6, :-1]).all()
    draw = np.random.default_rng(1)
    agree = []
    for _ in range(200):
        x = draw.integers(0, 2**63, 90).astype(np.uint64)
        agree.append(np.mean(minhash.signature(x[:80], circle) == minhash.signature(x[10:], circle)))
    assert abs(np.mean(agree) - 70 / 90) < 0.02  # the coordinates estimate the similarity
