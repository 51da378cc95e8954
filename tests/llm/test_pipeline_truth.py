"""The whole pipeline through run(), held against plain loops: which documents each stage keeps, with which texts."""

import zlib

import numpy as np
import zstandard
from test_operators import SF, WORDS, contamination, library, line_truth, simhash_truth

from strophe.llm import langid


def compressed(content, data):
    """Bytes of data in blocks, with a dictionary; made anew for each call."""
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
    return sum(len(c.compress(data[i : i + langid.TEXT_BLOCK])) for i in range(0, len(data), langid.TEXT_BLOCK))


def told(text, dictionaries):
    """The language of a text and whether its margin is enough; near ties take the dictionaries' parts along."""
    if not text or not langid._LETTER.search(text):
        return None, False
    data = langid.plain(text)
    sizes = {lang: float(compressed(d, data)) for lang, d in dictionaries.items()}
    low, high = sorted(sizes.values())[:2]
    if high - low <= langid.CLOSE:
        for lang, d in dictionaries.items():
            cut = [d[i * len(d) // langid.PARTS : (i + 1) * len(d) // langid.PARTS] for i in range(langid.PARTS)]
            sizes[lang] += np.mean([compressed(p, data) for p in cut if len(p) >= 8])
        low, high = sorted(sizes.values())[:2]
    return min(sorted(sizes), key=sizes.get), (high - low) / low >= langid.MIN_MARGIN and high > low


def test_near_ties_of_languages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    made = langid.fit(table)
    texts = ["ja", "no", "la la", "de", "a", "e", "problem", "hotel bar", "taxi", "radio", "o", "un", "in", "die"]
    got = {r.doc_id: (r.lang_pred, r.accepted) for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), made).collect()}
    assert got == {k: told(t, made) for k, t in enumerate(texts)}
    data = [langid.plain(t) for t in texts]
    ties = sum(np.diff(sorted(compressed(d, x) for d in made.values())[:2])[0] <= langid.CLOSE for x in data)
    assert ties >= 3  # the branch is taken


def test_run_is_what_plain_loops_keep(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = langid.fit(docs)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    kept = [(i, t) for i, t in rows if told(t, made)[1]]
    assert 0 < len(kept) < len(rows)
    gone = line_truth(kept)
    texts = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)) for i, t in kept]
    prints = {i: simhash_truth(t) for i, t in texts}
    left, groups = dict(texts), []
    for i, t in texts:  # ids ascend, so the first of a group is its least
        group = next((g for g in groups if any((prints[i] ^ prints[j]).bit_count() <= 4 for j in g)), None)
        near = [g for g in groups if any((prints[i] ^ prints[j]).bit_count() <= 4 for j in g)]
        merged = sorted({i}.union(*near)) if group else [i]
        groups = [g for g in groups if g not in near] + [merged]
    left = {g[0]: left[g[0]] for g in groups}
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i: t for i, t in left.items() if not contamination(t, bench)[1]}
    assert 0 < len(clean) < len(left) < len(kept)

    pieces = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert {r.doc_id for r in pieces} == set(clean)
    assert [r.sequence_id * 4096 + r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
    for i, t in clean.items():
        ids = [*library(WORDS, t), 2]
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        assert [(r.start, r.doc_tokens) for r in own] == [(s, len(ids)) for s in np.cumsum([0, *(r.length for r in own)])[:-1]]
        assert sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
