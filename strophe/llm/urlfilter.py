"""Operator 3: URL filters as a temporal list join.

A list is a log of dated entries (list_id, pattern, action 'add' or 'remove', at). ``intervals`` makes
each add valid from its date up to the next entry of the same list and pattern. ``evaluate`` gives every
capture the patterns that can match its url (the host and each of its parent domains, and each of these
with the first part of the path, the first two, and so on), joins them with the intervals on the pattern,
and keeps those that are valid at fetch time: an as-of join by an equi-join and a range test, with no cross
join. Hosts and paths are tried up to the lengths that the lists' patterns have, so a long url makes few.

A pattern may be written as a url: its scheme, ``*.`` before and port and dot after the host, query and a
last slash are left out, and its host is in lower case. Paths are compared with case, part by part.

Equal captures are counted before the shuffle and dealt out again after it. Patterns that no list holds
(``com``) are left out before the shuffle by a bitmap of the lists' patterns, of at most 4 MB. A pattern
that very many captures share is a skewed join key, which adaptive execution splits.

Of entries of the same date the last in the order 'add' < 'remove' wins. Null patterns, lists, dates and
other actions are left out. Captures with a null url or time match nothing; rows with null or repeated
ids are kept, one out for each one in. Empty tables on either side are fine; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, picked
from .linededup import _sieve


def normal(pattern: str) -> Column:
    """A pattern as captures try it; empty where it has no host."""
    bare = F.regexp_replace(F.trim(pattern), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/]*", 0)), r"^(?:\*?\.)|\.?(?::\d*)?$", "")
    return F.when(host == "", "").otherwise(F.concat(host, F.regexp_extract(bare, "^[^/]*(.*?)/*$", 1)))


def intervals(entries: DataFrame) -> DataFrame:
    """list_id, pattern, since, until (null: open) of each time an entry was active."""
    rows = picked(entries, list_id="list_id", pattern="pattern", action="action", at="at").withColumn("pattern", normal("pattern"))
    good = rows.where("list_id is not null and pattern <> '' and at is not null and action in ('add', 'remove')")
    last = good.groupBy("list_id", "pattern", "at").agg(F.max("action").alias("action"))
    own = Window.partitionBy("list_id", "pattern").orderBy("at")
    return last.withColumn("until", F.lead("at").over(own)).where("action = 'add'").select("list_id", "pattern", F.col("at").alias("since"), "until")


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a last dot."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::\d*)?(?:[/?#]|$)", 1))


def patterns_of(url: Column, labels: int, parts: int) -> Column:
    """The patterns of at most so many host labels and path parts that match a url."""
    names = F.split(host_of(url), "\\.")
    tail = F.slice(names, F.greatest(F.lit(1), F.size(names) - (labels - 1)), F.lit(labels))
    hosts = F.transform(F.array(tail), lambda t: F.transform(t, lambda _, i: F.array_join(F.slice(t, i + 1, F.lit(labels)), ".")))[0]
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    whole = F.slice(F.split(path, "/"), 1, parts) if parts else F.array().cast("array<string>")
    paths = F.transform(F.array(whole), lambda w: F.transform(w, lambda x, i: F.when(x != "", F.concat(F.lit("/"), F.array_join(F.slice(w, F.lit(1), i + 1), "/")))))[0]
    with_path = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    return F.filter(F.concat(hosts, with_path), lambda p: p.isNotNull() & (p != "") & ~p.startswith("/"))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """id_col, time_col, blocked, n_lists, lists (names, sorted, comma-joined) of each capture."""
    valid, _ = materialize(intervals(entries).withColumn("key", F.xxhash64("pattern")), "intervals")
    host, path = F.split(F.substring_index("pattern", "/", 1), "\\."), F.split("pattern", "/")
    labels, parts = valid.agg(F.coalesce(F.max(F.size(host)), F.lit(1)), F.coalesce(F.max(F.size(path)) - 1, F.lit(0))).first()
    own = picked(captures, id=id_col, url=url_col, t=time_col)
    counted = own.groupBy("id", "url", "t").agg(F.count(F.lit(1)).alias("copies"))
    tried = counted.where("url is not null and t is not null").select("id", "url", "t", F.explode(patterns_of(F.col("url"), labels, parts)).alias("pattern"))
    listed = _sieve(tried.withColumn("key", F.xxhash64("pattern")), "key", valid.select("key").distinct())
    active = listed.drop("key").join(valid.drop("key"), "pattern").where("since <= t and (until is null or t < until)")
    found = active.groupBy(F.col("id").alias("fid"), F.col("url").alias("furl"), F.col("t").alias("ft")).agg(F.sort_array(F.collect_set("list_id")).alias("names"))
    joined = counted.join(found, F.expr("id <=> fid and url = furl and t = ft"), "left").select("id", "t", "copies", F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    rows = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(F.col("id").alias(id_col), F.col("t").alias(time_col), (F.size("names") > 0).alias("blocked"), F.size("names").cast("long").alias("n_lists"), F.array_join("names", ",").alias("lists"))
