"""The queries of this subpackage: name -> function of (spark, sf_dir), and SQL where SQL can express one."""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpecount import count_tokens
from .common import load
from .decontam import detect
from .langid import fit, held_out, predict
from .linededup import line_report
from .merkle import manifest
from .minhash import near_duplicates as near_documents
from .packing import pack
from .rules import judge
from .simhash import near_duplicates
from .sstable import token_tables
from .trie import trie
from .urlfilter import evaluate, host_of
from .warc import archive


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies: in $STROPHE_TOKENIZERS, or in the installed public_tokenizers."""
    folder = os.environ.get("STROPHE_TOKENIZERS")
    return os.path.join(folder, name) if folder else importlib.import_module("public_tokenizers").path(name)


def op1_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tables(load(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), words=10)
    names = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched on day page_id mod 365. The list log is made of all their hosts:
    each is added on a day that its length and first letter give and removed 40 days later; hosts under
    example.com are added again for good; all of example.org is listed from day 100 to 200."""
    pages = load(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.pmod("page_id", F.lit(365)).alias("fetched"))
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern <> ''").distinct()
    day = F.pmod(F.length("pattern") * 37 + F.ascii("pattern") * 11, F.lit(300)).cast("long")
    listed = [
        hosts.select(F.lit("hosts").alias("list_id"), "pattern", F.lit("add").alias("action"), day.alias("at")),
        hosts.select(F.lit("hosts"), "pattern", F.lit("remove"), day + 40),
        hosts.where("pattern like '%.example.com'").select(F.lit("hosts"), "pattern", F.lit("add"), day + 90),
        spark.sql("select * from values ('domains', 'example.org', 'add', 100L), ('domains', 'example.org', 'remove', 200L), ('paths', 'example.net/en', 'add', 250L) as t(list_id, pattern, action, at)"),
    ]
    entries = listed[0].union(listed[1]).union(listed[2]).union(listed[3])
    return evaluate(captures, entries)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(load(spark, sf_dir, "pages"), min_bytes=0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(load(spark, sf_dir, "documents"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(load(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2, window=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return predict(docs, fit(docs.where(~held_out("doc_id"))))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), distance=4)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=1024)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(load(spark, sf_dir, "conversations"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document, by the CRC-32 of its id, arrives with its text's A-Z lower-cased."""
    return manifest(load(spark, sf_dir, "documents"), tampered=lambda i: F.crc32(i.cast("string").cast("binary")) % 3 == 0)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_tables, op2_decontaminate, op3_url_filters, op4_warc, op5_quality, op6_line_dedup, op7_pack, op8_language, op9_simhash, op10_token_counts, op11_prefix_trie, op12_merkle, op13_minhash)}
#: Unsigned CRC-32 of a text's UTF-8 bytes, bit by bit: the polynomial is fixed.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({0})), lambda i: ('0x' || hex(encode({0}))[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)))"""
_FIELDS = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars")) + " as head"
ORACLE_SQL: dict[str, str] = {
    "op3_url_filters": r"""
        with c as (select page_id, url, page_id % 365 as t, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) as host,
                          regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)', 1) as part from pages),
        h as (select distinct host as pattern, (length(host) * 37 + ascii(host) * 11) % 300 as day from c where host <> ''),
        e as (select 'hosts' as list_id, pattern, day as since, day + 40 as until from h
              union all select 'hosts', pattern, day + 90, 1000000 from h where pattern like '%.example.com'
              union all select 'domains', 'example.org', 100, 200
              union all select 'paths', 'example.net/en', 250, 1000000),
        m as (select distinct c.page_id, e.list_id from c join e on c.t >= e.since and c.t < e.until
              and (e.pattern = c.host or (e.list_id = 'domains' and (c.host = e.pattern or c.host like '%.' || e.pattern))
                   or (e.list_id = 'paths' and (c.host || c.part = e.pattern or c.host || c.part like '%.' || e.pattern)))),
        g as (select page_id, count(*) as n, string_agg(list_id, ',' order by list_id) as names from m group by page_id)
        select c.page_id, c.t as fetched, g.n is not null as blocked, coalesce(g.n, 0) as n_lists, coalesce(g.names, '') as lists
        from c left join g using (page_id)
    """,
    "op4_warc": r"""
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, html, strlen(html) as payload_bytes, sha1(html) as s, min(page_id) over (partition by html) as first from p)
        select page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') as payload_digest,
               case when page_id = first then 'response' else 'revisit' end as record_type,
               case when page_id <> first then first end as refers_to
        from d
    """,
    "op11_prefix_trie": rf"""
        with recursive t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as pos,
                                    coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
        c as (select conv_id, count(*) as n, {CRC32.format("cast(conv_id as varchar)")} % 4 as h from t group by conv_id),
        lent as (select c.conv_id, t.pos as depth, role, text from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and t.pos <= c.h),
        m as (select c.conv_id, h, coalesce(k, 0) as m from c left join (select conv_id, count(*) as k from lent group by conv_id) using (conv_id)),
        b as (select * from lent union all select t.conv_id, t.pos - h + m, role, text from t join m using (conv_id) where pos > h),
        walk as (select conv_id, 0 as depth, '' as node, '' as up, 0 as words from c
                 union all
                 select b.conv_id, b.depth, md5(walk.node || strlen(role) || ':' || role || text), walk.node, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))
                 from walk join b on b.conv_id = walk.conv_id and b.depth = walk.depth + 1),
        last as (select conv_id, max(depth) as depth from walk group by conv_id),
        e as (select node, sha256(string_agg(conv_id, ',' order by conv_id)) as ends from walk join last using (conv_id, depth) group by node),
        n as (select node, depth, any_value(up) as up, any_value(words) as words, count(*) as n_convs, min(conv_id) as conv_id from walk group by node, depth),
        k as (select up as node, count(*) as n_children from n where depth > 0 group by up),
        lines as (select node as top, node, depth from n union all select lines.top, n.node, n.depth from lines join n on n.up = lines.node and n.depth = lines.depth + 1),
        s as (select top as node, count(*) filter (k.node is null) as n_leaves, sum((n_convs - 1) * words) as saved
              from lines join n on n.node = lines.node left join k on k.node = lines.node group by top)
        select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved::bigint as saved_tokens, coalesce(ends, sha256('')) as ends_sha256
        from n join s on s.node = n.node left join k on k.node = n.node left join e on e.node = n.node left join n p on n.depth > 0 and p.node = n.up
    """,
    "op12_merkle": rf"""
        with recursive d as (select doc_id, source, lang, n_chars, text, {CRC32.format("cast(doc_id as varchar)")} % 3 = 0 as tampered from documents),
        e as (select doc_id, lang, tampered, {_FIELDS}, '-' as none, text is null as bare,
                     translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, text from d),
        l as (select doc_id, case when lang is null then '' else ':' || lang end as tree, tampered,
                     sha256(head || case when bare then '-' else strlen(text) || ':' || text end) as leaf,
                     sha256(head || case when bare then '-' else strlen(low) || ':' || low end) as lowered from e),
        n as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx from l),
        g as (select tree, 0 as h, idx, leaf as digest, count(*) over (partition by tree) as m from n
              union all
              select tree, h + 1, idx // 8, sha256(string_agg(digest, '' order by idx)), (any_value(m) + 7) // 8 from g where m > 1 group by tree, h, idx // 8),
        roots as (select tree, digest, h from g where m = 1),
        r as (select '' as tree, 0 as h, row_number() over (order by tree) - 1 as idx, digest, count(*) over () as m from roots
              union all
              select tree, h + 1, idx // 8, sha256(string_agg(digest, '' order by idx)), (any_value(m) + 7) // 8 from r where m > 1 group by tree, h, idx // 8),
        placed as (select tree, row_number() over (order by tree) - 1 as top, digest as subroot, h as depth from roots),
        nodes as (select tree, h, idx, digest, m from g where m > 1 union all select '#', h, idx, digest, m from r where m > 1),
        run as (select a.tree, a.h, a.idx, coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx < a.idx), '') as before,
                       coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx > a.idx), '') as after
                from nodes a join nodes b on a.tree = b.tree and a.h = b.h and a.idx // 8 = b.idx // 8 group by a.tree, a.h, a.idx),
        step as (select n.tree, n.idx as leaf_idx, run.h as level, run.before, run.after from n join run on run.tree = n.tree and run.idx = n.idx // cast(pow(8, run.h) as bigint)
                 union all
                 select n.tree, n.idx, p.depth + run.h, run.before, run.after from n join placed p using (tree) join run on run.tree = '#' and run.idx = p.top // cast(pow(8, run.h) as bigint)),
        way as (select tree, leaf_idx, list(before order by level) as befores, list(after order by level) as afters, sha256(string_agg(before || after, '' order by level)) as proof from step group by all),
        f as (select n.tree, n.idx, case when n.tampered then n.lowered else n.leaf end as digest, 0 as level from n
              union all
              select f.tree, f.idx, sha256(way.befores[f.level + 1] || f.digest || way.afters[f.level + 1]), f.level + 1
              from f join way on way.tree = f.tree and way.leaf_idx = f.idx where f.level < len(way.befores)),
        last as (select tree, idx, arg_max(digest, level) as folded_root from f group by tree, idx)
        select n.doc_id, n.leaf, p.subroot, (select digest from r where m = 1) as root, coalesce(way.proof, sha256('')) as proof_sha256,
               last.folded_root, last.folded_root = (select digest from r where m = 1) as verified
        from n join placed p using (tree) join last on last.tree = n.tree and last.idx = n.idx
        left join way on way.tree = n.tree and way.leaf_idx = n.idx
    """,
    "op13_minhash": r"""
        with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
                             else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end as g from d),
        k as (select doc_id, len(g) as n, md5(array_to_string(list_sort(g), chr(10))) as name, g from s),
        u as (select name, any_value(n) as n, any_value(g) as g, min(doc_id) as least from k where n > 0 group by name),
        p as (select name, n, unnest(g) as shingle from u),
        pairs as (select a.name as x, b.name as y, count(*) as c, any_value(a.n) + any_value(b.n) as total from p a join p b on a.shingle = b.shingle and a.name < b.name group by a.name, b.name),
        links as (select x, y from pairs where 100 * c >= 80 * (total - c)),
        edges as (select x, y from links union all select y, x from links),
        reach as (select name, name as other from u union select reach.name, edges.y from reach join edges on edges.x = reach.other),
        best as (select reach.name, min(u.least) as component_id from reach join u on u.name = reach.other group by reach.name)
        select doc_id, n::bigint as n_shingles, case when n = 0 then doc_id else component_id end as component_id,
               doc_id is not distinct from case when n = 0 then doc_id else component_id end as kept
        from k left join best using (name)
    """,
}
