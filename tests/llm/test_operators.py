"""The ten operators against brute force, on hard rows and on the smallest tables."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strophe.llm import bpecount, components, decontam, langid, linededup, packing, queries, rules, simhash, sstable, tokens, urlfilter, warc

SF = "/root/testdata/sf0.001"
BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LINE = "the quick brown fox jumps over the lazy dog near the river bank today"
TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "Hello  World\n\n again 's don't <|endoftext|> x\x01y İΣ 中文 123",
    LINE,
    LINE + "\n" + LINE.replace("lazy", "hazy") + "\nshort",
    LINE,
    "word " * 3000,
    "x" * 20000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src0", "clash", 7) for i, t in enumerate(TEXTS)] + [(None, LINE, None, None, None, None), (3, "one", "en", "src0", "clash", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, start string, n_tokens int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def library(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_encode_as_whole_texts(path):
    import random

    import pyarrow as pa

    draw = random.Random(3)
    signs = ["a", "b", " ", "  ", "\n", "\t", "é", "<|endoftext|>", "'s", "1", ".", "\x1c", "́", "\x85", "Σ", "İ", "中", "　", "ll", ", "]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 25))) for _ in range(3000)]
    own = tokens.Encoder(path)
    got = []
    for ids, lengths in own.ids(pa.array(texts)):
        ends = np.cumsum(lengths)
        got += [ids[e - n : e].tolist() for e, n in zip(ends, lengths)]
    assert got == [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]


def test_a_small_memory_of_pieces_changes_nothing(monkeypatch):
    import pyarrow as pa

    texts = [f"{LINE} {i * 7919} word{i % 50}" for i in range(300)]
    monkeypatch.setattr(tokens, "MEMO_PIECES", 20)
    monkeypatch.setattr(tokens, "GROUP_BYTES", 200)
    own = tokens.Encoder(BYTES)
    got = [ids.tolist() for ids, _ in map(lambda g: own._group(g), tokens.groups(pa.array(texts), 200))]
    assert [x for g in got for x in g] == [x for e in own.library.encode_batch(texts, add_special_tokens=False) for x in e.ids]


def test_dropped_spaces_make_no_pieces_of_their_own(monkeypatch):
    import pyarrow as pa

    draw = random.Random(5)
    words = ["word", "Word", "क़", "ǅ", "ªº", "x́", "a1", "...", "'s", "don't", "<|endoftext|>", "中文", "İ", "Σ", "é.", "a,b", "</w>", "w>", "\x01"]
    texts = ["".join(draw.choice(words) + draw.choice([" ", "  ", "\n"]) for _ in range(draw.randint(0, 12))).strip() for _ in range(2000)]
    monkeypatch.setattr(tokens, "CALL_PIECES", 7)
    monkeypatch.setattr(tokens, "MEMO_DROPPED", 20)
    own = tokens.Encoder(WORDS)
    signs = [c for c in map(chr, range(0x41, 0x100)) if tokens.LATIN.fullmatch(c)]
    words = [*signs, *(a + b + a for a, b in zip(signs, reversed(signs)))]
    assert own._small(" ".join(words)).tolist() == library(WORDS, " ".join(words))
    got = [i for ids, _ in own.ids(pa.array(texts)) for i in ids.tolist()]
    assert got == [i for e in own.library.encode_batch(texts, add_special_tokens=False) for i in e.ids]
    assert own.mark is not None and own.last.any() and "word" in own.known and not [p for p in own.known if " " in p]


def test_token_counts(docs, none):
    got = sorted(bpecount.count_tokens(docs, BYTES).collect(), key=str)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(library(BYTES, r.text)), n > 1024) for r in docs.collect()]
    assert got == sorted(want, key=str) or [tuple(x) for x in got] == sorted(want, key=str)
    assert bpecount.count_tokens(none, BYTES).count() == 0


def test_token_tables(spark, docs, none, tmp_path):
    path = f"file://{tmp_path}/sst"
    rows = sstable.token_tables(docs, BYTES, end_id=0, path=path).collect()
    want = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    expected = []
    for doc_id, text in want:
        ids = [*library(BYTES, text), 0]
        expected.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((tuple(r) for r in rows), key=lambda r: r[1]) == expected
    found = sstable.lookup(spark, path, spark.createDataFrame([(3,), (5,), (99,)], "doc_id long")).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in found) == sorted([(3, [*library(BYTES, "one"), 0])] * 2 + [(5, [*library(BYTES, LINE), 0])])
    assert sstable.token_tables(none, BYTES).count() == 0


def test_shard_blocks_and_repeated_keys():
    entries = [(sstable.key_of(i // 3), bytes([i % 256]) * 2000) for i in range(600)]
    shard = sstable.Shard(b"".join(p + b"\n" for p in sstable.shard_parts(entries, 2)))
    assert len(shard.blocks) > 5 and list(shard) == entries
    for k in (0, 17, 110, 199):
        assert len(shard.get(k)) == 3
    assert shard.get(5000) == [] and shard.get(None) == []


def test_packing(docs, none):
    rows = packing.pack(docs, WORDS, end_id=2, window=64).collect()
    line = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    assert [r.sequence_id * 64 + r.offset for r in line] == np.cumsum([0, *(r.length for r in line)])[:-1].tolist()
    assert all(r.length == len(r.ids) // 4 for r in rows)
    whole = {}
    for r in line:
        whole.setdefault((r.doc_id, r.sequence_id * 64 + r.offset - r.start), []).append(np.frombuffer(bytes(r.ids), "<u4"))
    got = sorted(((k[0], np.concatenate(v).tolist()) for k, v in whole.items()), key=str)
    assert got == sorted(((r.doc_id, [*library(WORDS, r.text), 2]) for r in docs.collect()), key=str)
    assert packing.pack(none, WORDS).count() == 0


def contamination(text, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(size, len(w))
        for window in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) == window:
                    hit.update(range(i, i + n))
                    names.add(name)
    return len(own), len(hit), sorted(names - {None})


ITEMS = [("7", "quick brown fox jumps over the lazy dog near the river bank"), ("12", "ONE"), ("9", None), ("8", "..."), ("7", "hazy dog near the"), (None, "short"), ("x", "word " * 12)]


def longest_truth(doc_id, text, items, size=10):
    """Every match of size words (of a whole shorter item) that can't be prolonged to the left, at its full length."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = words(text)
    for name, item in items:
        w = words(item)
        for i in range(len(own)):
            for j in range(len(w)):
                n = 0
                while i + n < len(own) and j + n < len(w) and own[i + n] == w[j + n]:
                    n += 1
                if n and n >= min(size, len(w)) and not (i and j and own[i - 1] == w[j - 1]):
                    yield doc_id, name, i, j, n


def test_decontamination(spark, docs, none, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    want = sorted(((r.doc_id, *contamination(r.text, ITEMS)) for r in docs.collect()), key=str)
    for bound, at_once in ((1_000_000, 8), (5, 8), (5, 1)):  # one block, many, and one a round
        monkeypatch.setattr(decontam, "TEST_WORDS", bound)
        monkeypatch.setattr(decontam, "ROUND_BLOCKS", at_once)
        got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontam.detect(docs, bench).collect()), key=str)
        assert got == want
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(1 for w in want if w[2] == 0)
    found = sorted((tuple(r) for r in decontam.matches(docs, bench).collect()), key=str)
    assert found == sorted((m for r in docs.collect() for m in longest_truth(r.doc_id, r.text, ITEMS)), key=str)
    assert (5, "7", 1, 0, 12) in found and (6, "7", 1, 0, 12) in found
    assert decontam.detect(none, bench).count() == 0
    assert decontam.detect(docs, bench.where("false")).where("contaminated").count() == 0
    clashing = docs.selectExpr("*", "1 as TEXT", "2 as `Doc_Id`", "3 as hit")
    assert decontam.detect(clashing, bench).count() == docs.count()
    assert decontam.clean(clashing, bench).columns == clashing.columns


def pairs_found(ids, block):
    return sorted(pair for part in decontam.longest(ids, block) for pair in zip(*(x.tolist() for x in part)))


def test_longest_matches_of_texts_that_repeat_words(monkeypatch):
    rng = random.Random(7)
    for _ in range(150):
        monkeypatch.setattr(decontam, "PAIRS", rng.choice([1, 7, 1 << 20]))
        monkeypatch.setattr(decontam, "STEPS", rng.choice([0, 1, 64]))
        letters = [b"a", b"b", b"c"][: rng.choice([1, 2, 3])]
        block = decontam.TestBlock([(str(i), [rng.choice(letters) for _ in range(rng.choice([0, 2, 5, 12, 30]))]) for i in range(3)], 4)
        ids, _ = decontam._laid_out([block.number([rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 40))]) for _ in range(3)])
        want = []
        for place in range(1, len(ids)):
            for test, least in zip(block.at.tolist(), block.size.tolist()):
                n = 0
                while ids[place + n] == block.ids[test + n] and ids[place + n] != 0:
                    n += 1
                if n >= least and (ids[place - 1] != block.ids[test - 1] or ids[place - 1] == 0):
                    want.append((place, test, n))
        assert pairs_found(ids, block) == sorted(want)


def test_equal_words_take_memory_in_proportion():
    import tracemalloc

    block = decontam.TestBlock([("i", [b"a"] * 2_000)], 10)
    ids, _ = decontam._laid_out([block.number([b"a"] * 20_000)])
    tracemalloc.start()
    found = pairs_found(ids, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # an item that begins anywhere, or a document that begins inside the item
    assert len(found) == 20_000 - 9 + 2_000 - 9 - 1 and max(n for _, _, n in found) == 2_000
    assert peak < 60_000_000


def test_suffixes_left_out_end_no_search():
    """The array of the suffixes that begin a window finds what the array of all of them finds."""
    rng = random.Random(9)
    words = [b"w%d" % i for i in range(6)]
    for _ in range(40):
        block = decontam.TestBlock([(str(i), [rng.choice(words[:4]) for _ in range(rng.choice([1, 3, 9]))]) for i in range(3)], 5)
        ids, _ = decontam._laid_out([block.number([rng.choice(words) for _ in range(60)]) for _ in range(3)])
        some, every = decontam.Shard(ids, block), decontam.Shard(ids, block)
        at = np.arange(len(ids))
        columns = decontam._columns(ids, at, block.words, block.words, block.bits)
        order = np.lexsort(columns[::-1])
        every.suffixes, every.columns = at[order], [c[order] for c in columns]
        found = [set(zip(*(x.tolist() for x in shard.search(block)))) for shard in (some, every)]
        assert found[0] == {(p, w) for p, w in found[1] if ids[p]} and len(some.suffixes) <= len(every.suffixes)


def test_intervals_and_captures(spark):
    entries = spark.createDataFrame([("a", "bad.com", "add", 10), ("a", "bad.com", "remove", 20), ("a", "bad.com", "add", 20), ("a", "bad.com", "add", 30), ("b", "x.org/ads", "add", 5), ("b", None, "add", 5), (None, "bad.com", "add", 0)], "list_id string, pattern string, action string, at long")
    pages = spark.createDataFrame([(1, "http://www.bad.com/p", 10), (2, "http://bad.com", 20), (3, "https://u@BAD.com:80/?q", 31), (4, "http://x.org/ads/1", 9), (5, "http://x.org/adsense", 9), (6, None, 9), (None, "http://notbad.com/", 15), (1, "http://www.bad.com/p", 10), (7, "http://bad.com", None)], "page_id long, url string, fetched long")
    got = sorted((tuple(r) for r in urlfilter.evaluate(pages, entries).collect()), key=str)
    hit = lambda i, t, n: (i, t, bool(n), 1 if n else 0, n)
    assert got == sorted([hit(1, 10, "a"), hit(1, 10, "a"), hit(2, 20, ""), hit(3, 31, "a"), hit(4, 9, "b"), hit(5, 9, ""), hit(6, 9, ""), hit(None, 15, ""), hit(7, None, "")], key=str)
    assert urlfilter.evaluate(pages, entries.where("false")).where("blocked").count() == 0
    deep = spark.createDataFrame([("p", "HTTPS://*.Shop.example:443/a/b/?x", "add", 0), ("q", "shop.example/a/b/c", "add", 0), ("r", "example./", "add", 7), ("s", "shop.example//b", "add", 0), ("t", "  ", "add", 0)], "list_id string, pattern string, action string, at long")
    urls = ["http://shop.example/a/b", "http://m.shop.example/a/b/", "http://shop.example/a/b/c/d?e", "http://shop.example/a/bc", "http://shop.example/A/b", "http://shop.example//b", "http://" + "x." * 5_000 + "shop.example/" + "a/" * 5_000, "http://shop.example/a/b#c/d", "/a/b"]
    at = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "5L as fetched", "0 as URL", "1 as Page_Id")
    assert {r.page_id: r.lists for r in urlfilter.evaluate(at, deep).collect()} == {0: "p", 1: "p", 2: "p,q", 3: "", 4: "", 5: "s", 6: "", 7: "p", 8: ""}
    assert {r.page_id: r.lists for r in urlfilter.evaluate(at.drop("fetched").withColumn("fetched", F.lit(7)), deep).collect()} == {0: "p,r", 1: "p,r", 2: "p,q,r", 3: "r", 4: "r", 5: "r,s", 6: "r", 7: "p,r", 8: ""}
    assert urlfilter.evaluate(pages.where("false"), entries).count() == 0


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(4, "http://a/\r\nX: y", "<p>é\r\n\r\nWARC/1.1</p>", 1), (2, "http://b", "<p>é\r\n\r\nWARC/1.1</p>", 1), (9, None, None, 1), (1, "u", "", 1), (7, "u", "only", 1)], "page_id long, url string, html string, digest int")
    path = f"file://{tmp_path}/archive"
    rows = {r.page_id: r for r in warc.archive(pages, path).collect()}
    import base64

    for r in pages.collect():
        data = (r.html or "").encode()
        first = min(x.page_id for x in pages.collect() if (x.html or "") == (r.html or ""))
        assert tuple(rows[r.page_id]) == (r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first == r.page_id else "revisit", None if first == r.page_id else first)
    whole = {r.page_id: bytes(r.record) for r in warc.reconstruct(spark, path).collect()}
    assert whole[2].endswith("\r\n\r\n<p>é\r\n\r\nWARC/1.1</p>\r\n\r\n".encode()) and b"Refers-To: <urn:page:2>" in whole[4] and b"%0D%0AX: y" in whole[4]
    warc.export_warc(spark, path, f"file://{tmp_path}/out")
    written = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(f"file://{tmp_path}/out").collect())
    assert len(written) == sum(map(len, whole.values())) and all(w in written for w in whole.values())
    small = {r.page_id: r.record_type for r in warc.archive(pages, min_bytes=1).collect()}
    assert small[9] == "response" and small[4] == "revisit"
    assert warc.archive(pages.where("false")).count() == 0
    odd = spark.createDataFrame([(None, "u", "same"), (3, "u", "same"), (3, "v", "same"), (None, "w", None)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive(odd).collect()), key=str)
    assert got == sorted([(None, "revisit", 3, 4), (3, "response", None, 4), (3, "response", None, 4), (None, "response", None, 0)], key=str)


def test_damaged_archives_are_refused(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abcd")], "page_id long, url string, html string")
    for k, (table, change) in enumerate([("payloads", {"payload": F.lit(b"abd")}), ("records", {"header": F.regexp_replace("header", "Content-Length: 3", "Content-Length: 4")}), ("records", {"page_id": F.col("page_id") + 1})]):
        path = f"file://{tmp_path}/{k}"
        warc.write_archive(pages, path)
        rows = spark.read.parquet(f"{path}/{table}").withColumns(change).collect()
        schema = spark.read.parquet(f"{path}/{table}").schema
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{table}")
        with pytest.raises(Exception, match="damaged"):
            warc.read_archive(spark, path).collect()


def test_compression_equals_a_plain_loop(spark):
    import zstandard

    rows = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").collect()
    labelled = spark.read.parquet(f"{SF}/documents.parquet").where(~langid.held_out("doc_id"))
    made = langid.fit(labelled)
    got = {r.doc_id: (r.lang_pred, r.accepted) for r in langid.predict(spark.createDataFrame(rows), made).collect()}
    for r in rows:
        if not r.text or not langid._LETTER.search(r.text):
            assert got[r.doc_id] == ("und", False)
            continue
        data = langid.plain(r.text)
        sizes = {}
        for lang, content in made.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(data[i : i + langid.TEXT_BLOCK])) for i in range(0, len(data), langid.TEXT_BLOCK))
        best = sorted(sizes.values())
        if best[1] - best[0] > langid.CLOSE:
            assert got[r.doc_id][0] == min(sizes, key=sizes.get)
            assert got[r.doc_id][1] == ((best[1] - best[0]) / best[0] >= langid.MIN_MARGIN)


def test_repeated_rows_do_not_swell_the_sample(spark):
    same = spark.createDataFrame([(7, "the same text again and again", "en")] * 3000 + [(8, "un autre texte", "fr")], "doc_id long, text string, lang string")
    assert set(langid.fit(same)) == {"en", "fr"}


def quality(text):
    text = text or ""
    blank = "\x20\x09\x0a\x0b\x0c\x0d"
    words = re.findall(f"[^{blank}]+", text)
    lines = [x for x in text.split("\n") if x.strip(blank)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, docs):
    more = docs.union(spark.createDataFrame([(50, "a b c d e f g h a b c d e f g h x y a b c d e f g h", "", "", "", 1), (51, " 🙂é ## ab c\n\n##\n##\r\n", "", "", "", 1), (52, "a " * 30, "", "", "", 1)], docs.schema))
    got = sorted((tuple(r) for r in rules.statistics(more).collect()), key=str)
    assert got == sorted(((r.doc_id, *quality(r.text)) for r in more.collect()), key=str)


def test_decision_list(spark):
    rows = [(i, "good words of a plain text that goes on for some time " * 3 + str(i), 1) for i in range(60)] + [(100 + i, "## $$ %% && junk ** || " * 9 + str(i), 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = rules.judge(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    assert {r.doc_id: r.kept for r in got.collect() if not r.base_failed and r.kept != (r.doc_id < 100)} == {}
    measured = rules.statistics(docs)
    assert rules.learn(measured, docs.where("false")) == []
    assert rules.judge(docs.where("false"), docs).count() == 0
    learned = rules.learn(measured, docs)
    assert learned and all(">" in r.sql() or "<=" in r.sql() for r in learned)


def line_truth(rows):
    """Line numbers removed from each (id, text), by all pairs."""
    where = {}
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n") if t is not None else []):
            if x.strip(linededup.BLANK):
                where.setdefault(x, []).append((i, n))
    texts = sorted(where)
    sets = [{x[k : k + linededup.SHINGLE] for k in range(len(x) - linededup.SHINGLE + 1)} for x in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    posted = {}
    for a, s in enumerate(sets):
        for g in s:
            posted.setdefault(g, []).append(a)
    near = {p for at in posted.values() for p in combinations(at, 2)}
    for a, b in near:
        common = len(sets[a] & sets[b])
        if common >= linededup.SIMILARITY * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    best = {}
    for a, x in enumerate(texts):
        for o in where[x]:
            best[find(a)] = min(best.get(find(a), o), o)
    return {o for a, x in enumerate(texts) for o in where[x] if o != best[find(a)]}


def test_line_dedup(spark, docs, none):
    base = [f"line number {i} of the invented text has words like {i * 7919} and {i * 104729}" for i in range(40)]
    rows = [(i, "\n".join([base[i], base[(i * 3) % 40] + "!" * (i % 3), "tiny"])) for i in range(40)]
    mine = spark.createDataFrame(rows, "doc_id long, text string")
    want = line_truth(rows)
    got = {(r.doc_id, int(n)) for r in linededup.line_report(mine).collect() for n in r.removed.split(",") if n}
    assert got == want and want
    kept = linededup.dedup_lines(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    texts = [r.text for r in kept.where("doc_id in (5, 6, 7) or doc_id is null").orderBy(F.col("doc_id").asc_nulls_first()).collect()]
    assert texts == [LINE, "", "short", ""]  # one changed character of 69: similarity 0.857
    assert linededup.line_report(none).count() == 0 and linededup.dedup_lines(none).count() == 0


def test_short_lines_are_deduplicated(spark):
    rows = [(1, "Les.\n\nAll rights reserved.\n \t\nabc\n🙂🙂🙂"), (2, "Les.\n\nAll rights reserved!\n \t\nabd\n🙂🙂🙂"), (3, "All rights reserved.\nLes.\nab"), (4, "Les.\nLes.")]
    got = {(r.doc_id, r.removed) for r in linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, ""), (2, "0,2,5"), (3, "0,1"), (4, "0,1")}
    texts = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert texts == {1: rows[0][1], 2: "\n \t\nabd", 3: "ab", 4: ""}


def test_small_edits_of_lines_link(spark):
    import random
    import string

    draw = random.Random(4)
    base = ["".join(draw.choice(string.ascii_lowercase) for _ in range(n)) for n in (49, 55, 60, 66, 71, 90)]
    edited = [x[:20] + "#" + x[21:] for x in base]
    two = [x[:30] + "##" + x[32:] for x in base[2:]]
    rows = [(i, t) for i, t in enumerate(base + edited + two)]
    report = linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in report if r.n_removed} == set(range(len(base), len(rows)))


def test_recall_of_short_alike_lines(spark):
    import random
    import string

    draw = random.Random(6)
    extra = linededup.SHINGLE
    pairs = []
    for _ in range(2000):  # 4 * extra shingles in common, extra in one line alone: a similarity of 0.8
        x = "".join(draw.choice(string.ascii_letters) for _ in range(4 * extra + linededup.SHINGLE - 1))
        pairs.append((x, x + "".join(draw.choice(string.digits) for _ in range(extra))))
    rows = [(i, "\n".join(p)) for i, p in enumerate(pairs)]
    report = linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sum(r.n_removed == 0 for r in report) <= 20 and all(r.removed in ("", "1") for r in report)


def test_first_shingles_of_lines(spark):
    import random

    draw = random.Random(8)
    base = "".join(draw.choice("abcdefgh ") for _ in range(120))
    lines = [base[:k] + draw.choice("XYZ") + base[k + 1 :] for k in draw.sample(range(120), 40)] + ["".join(draw.choice("abcdefgh ") for _ in range(60)) for _ in range(20)]
    sets = [{x[k : k + linededup.SHINGLE] for k in range(len(x) - linededup.SHINGLE + 1)} for x in lines]
    texts = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    labelled = spark.createDataFrame([(i, i // 2) for i in range(len(lines))], "lid long, label long")
    rare = linededup._rare(labelled, texts).collect()
    holders = {}
    for r in rare:
        holders.setdefault(r.h, set()).add(r.label)
    assert all(r["size"] == len(sets[r.lid]) and 0 <= r["at"] <= len(sets[r.lid]) / 5 for r in rare)
    assert max(r.lid for r in rare) < 40  # unlike lines have too many shingles of their own to be looked up
    want = {(a, b) for b, a in combinations(range(len(lines)), 2) if a // 2 != b // 2 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {tuple(r) for r in linededup._rare_pairs(labelled, texts).collect()}
    assert len(want) > 100 and want <= got
    assert linededup.SMALL <= 16  # pairs within a bucket grow with its square


def test_lines_just_unlike_a_family_are_not_paired_with_it(spark):
    """Lines that are 0.72 alike to a group of copies, by pieces that are frequent elsewhere, make no pairs that grow with the product of both."""
    import random
    import string

    draw = random.Random(9)
    bases = ["".join(draw.choice(string.ascii_lowercase) for _ in range(300)) for _ in range(2)]
    made = []  # (family, label, line)
    for b, copies in ((0, 40), (1, 100)):
        for _ in range(copies):
            k = draw.randrange(300)
            made.append((b, b, bases[b][:k] + draw.choice("0123456789") + bases[b][k + 1 :]))
        for i in range(30):
            k, j = draw.randrange(20, 240), draw.randrange(20, 240)
            made.append((b, 100 * (b + 1) + i, bases[b][:k] + bases[1 - b][j : j + 40] + bases[b][k + 40 :]))
        made.append((b, 1000 + b, bases[b][:150] + "#####" + bases[b][155:]))
    sets = [{x[k : k + linededup.SHINGLE] for k in range(len(x) - linededup.SHINGLE + 1)} for _, _, x in made]
    texts = spark.createDataFrame([(i, x) for i, (_, _, x) in enumerate(made)], "lid long, line string")
    labelled = spark.createDataFrame([(i, label, family) for i, (family, label, _) in enumerate(made)], "lid long, label long, family long")
    want = {(a, b) for b, a in combinations(range(len(made)), 2) if made[a][1] != made[b][1] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {tuple(r) for r in linededup._rare_pairs(labelled, texts).collect()}
    assert len(want) > 100 and want <= got
    assert len(got) <= len(want) + 500  # the outer lines and the copies of both families are 4,200 pairs


def test_families_are_joined_by_keys_and_labels(spark):
    rows = [(1, 10, 100), (1, 11, 101), (2, 12, 101), (2, 13, 102), (3, 14, 103), (3, 15, 104)]
    got = linededup._families(spark.createDataFrame(rows, "key long, lid long, label long")).collect()
    families = {}
    for r in got:
        families.setdefault(r.family, set()).add((r.lid, r.label))
    assert sorted(map(sorted, families.values())) == [[(10, 100), (11, 101), (12, 101), (13, 102)], [(14, 103), (15, 104)]]


def test_signatures_are_narrow(spark, tmp_path):
    """Texts are dealt out once, no minima are; a line's signature is of 15 words, where keys of all bands were 37."""
    import random

    draw = random.Random(10)
    rows = [(i % 3900, "".join(draw.choice("abcdefgh ") for _ in range(60))) for i in range(3900)]
    lines = spark.createDataFrame(rows + rows[:100], "lid long, line string")
    signed = linededup.signatures(lines)
    plan = signed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate explode") < plan.index("Exchange ")
    signed.coalesce(1).write.parquet(str(tmp_path / "signed"))
    assert sum(f.stat().st_size for f in (tmp_path / "signed").glob("*.parquet")) < 160 * 3900
    weights = {r.lid: r.weight for r in signed.collect()}
    assert len(weights) == 3900 and all(w == 4 * (1 + (i < 100)) for i, w in weights.items())  # 56 shingles in steps of 16


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (300, 200), (200, 250)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(path, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 300: 200, 200: 200, 250: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def simhash_truth(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, none):
    rows = simhash.near_duplicates(docs).collect()
    prints = [(r.doc_id, simhash_truth(r.text)) for r in docs.collect()]
    want = []
    for i, p in prints:
        reach, new = {p}, True
        while new:
            new = {q for _, q in prints if q not in reach and any((q ^ x).bit_count() <= 4 for x in reach)}
            reach |= new
        want.append((i, f"{p:016x}", min((j for j, q in prints if q in reach and j is not None), default=None)))
    assert sorted((tuple(r) for r in rows), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(c) for _, _, c in want})
    nameless = spark.createDataFrame([(None, LINE, 1), (None, LINE, 2), (None, "one two three", 3), (4, "four five", 4), (4, "four five", 5), (4, "six", 6)], "`doc.id` long, text string, x int")
    got = simhash.keep_one(nameless, id_col="doc.id")
    assert got.columns == nameless.columns and sorted(str(tuple(r)[:2]) for r in got.collect()) == sorted(str(t) for t in [(None, LINE), (None, "one two three"), (4, "four five"), (4, "six")])


def test_all_quadruples_hold_a_triple():
    assert len(simhash.TRIPLES) == 20 and all(any(t in simhash.TRIPLES for t in combinations(q, 3)) for q in combinations(range(8), 4))


def test_large_postings_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    draw = np.random.default_rng(5)
    centre = draw.integers(0, 2**63, 4)
    prints = sorted({int(c) ^ sum(1 << int(b) for b in draw.choice(64, 4, replace=False)) for c in centre for _ in range(80)})
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    got = {r.node % (1 << 64): r.component for r in components.components(simhash.links(nodes)).collect()}
    root = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(prints, 2):
            if (a ^ b).bit_count() <= 4 and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert groups(got) == [g for g in groups(root) if len(g) > 1]


def test_language(spark, docs, none):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    made = langid.fit(table.where(~langid.held_out("doc_id")))
    assert set(made) == {"en", "de", "fr", "es"} and all(len(d) <= langid.DICTIONARY for d in made.values())
    rows = langid.predict(table, made).join(table.select("doc_id", "lang", "text"), "doc_id").where("held_out and length(text) >= 40").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.95
    odd = {r.doc_id: r for r in langid.predict(docs, made).collect()}
    assert all((odd[i].lang_pred, odd[i].score, odd[i].accepted) == ("und", 0.0, False) for i in (0, 1, 2)) and odd[5].lang_pred == "en"
    assert langid.predict(none, made).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}
    kept = langid.accepted(docs, made)
    assert kept.columns == docs.columns and kept.where("doc_id in (0, 1, 2)").count() == 0
    assert langid.fit(none) == {}


def test_columns_are_found_whatever_others_are_called(spark, docs, tmp_path):
    """A column that differs from a named one in case only is another column, and names may hold dots."""
    word, byte = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
    clashing = docs.selectExpr("*", "1 as TEXT", "2 as Doc_Id", "3 as `a.b`", "4 as chosen_id", "5 as gone")
    dotted = docs.select(F.col("doc_id").alias("the.id"), F.col("text").alias("the.text"))
    names = {"id_col": "the.id", "text_col": "the.text"}
    labels = spark.createDataFrame([(1, 0), (None, 1), (1, 0)], "doc_id long, quality int").selectExpr("*", "'x' as Doc_id")

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    for work in (
        lambda d, **n: bpecount.count_tokens(d, byte, **n),
        lambda d, **n: packing.pack(d, word, **n),
        lambda d, **n: simhash.fingerprints(d, **n),
        lambda d, **n: linededup.lines_of(d, **n),
        lambda d, **n: rules.statistics(d, **n),
        lambda d, **n: langid.predict(d, {}, **n).drop("the.id", "doc_id"),
    ):
        plain = rows(work(docs))
        assert rows(work(clashing)) == plain and rows(work(dotted, **names)) == plain
    assert rows(rules.judge(clashing, labels)) == rows(rules.judge(docs, labels.toDF("doc_id", "quality", "other")))
    plain = rows(sstable.token_tables(docs, byte))
    assert rows(sstable.token_tables(clashing, byte)) == plain
    for keep in (simhash.keep_one, linededup.dedup_lines):
        kept = keep(clashing)
        assert kept.columns == clashing.columns and rows(kept.toDF(*[f"c{i}" for i in range(len(kept.columns))]).select(*[f"c{i}" for i in range(len(docs.columns))])) == rows(keep(docs))


def test_queries_are_named(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs, _ = corpus_pipeline.materialize(docs, "test")
    rows = docs.collect()
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows and not any(contamination(r.text, bench)[1] for r in rows)
    prints = [simhash_truth(r.text) for r in rows]
    assert not any((a ^ b).bit_count() <= 4 for a, b in combinations(prints, 2))
    assert not line_truth([(r.doc_id, r.text) for r in rows])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(p.length for p in pieces) == sum(len(library(WORDS, r.text)) + 1 for r in rows)


def test_pipeline_of_nothing_and_of_nulls(spark):
    import corpus_pipeline

    prose = ["the river ran past the old mill and the children played there all day", "le chat dort sur le lit et le chien court dans le jardin toute la nuit"]
    rows = [(None,) * 6, (1, None, "en", None, None, "x"), (2, "", "en", "s", 0, None), (3, " \n\t", None, "s", 3, None), (None, prose[0] + " a", "en", None, 5, "y"), (None, prose[0] + " a", "en", None, 5, "y")]
    rows += [(10 + i, f"{prose[i % 2]} {i * 7919} {'ab' * i} {i * i}", ("en", "fr")[i % 2], "s", 1, None) for i in range(40)]
    rows += [(60, prose[1], "fr", "s", 1, None)] * 3 + [(61, ("long words of one very long text " * 40 + "\n") * 900, "en", "s", 1, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `odd.name` string"
    for docs in (spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame([], schema)):
        empty, columns = docs.isEmpty(), docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == columns, name
            docs, _ = corpus_pipeline.materialize(docs, "test")
        left = docs.collect()
        assert all(r.n_chars == len(r.text) for r in left) and len({(r.doc_id, r.text) for r in left}) == len(left)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert sum(p.length for p in pieces) == sum(len(library(WORDS, r.text)) + 1 for r in left)
        assert bool(left) != empty and not any(r.doc_id in (1, 2, 3) for r in left)
