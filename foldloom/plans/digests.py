"""Row-order independent SHA-256 digests of large sets.

``tree_digest``: equal lines are counted, every ``hash:count`` entry falls into one of 16**6 leaves by
its first hex digits, and leaves are hashed upwards in two steps of at most 4,096 children each. Copies are
counted before they can meet in a leaf, so no task holds more than one leaf's distinct lines.

``member_sums``: sixteen integer sums over the 16-bit pieces of each SHA-256. Sums add and subtract, so the
digest of "all records but these groups" needs the sums of the groups only and no list of its members. It
detects accidental differences; for tamper evidence use ``tree_digest``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 16


def hash_lines(lines: str | Column) -> Column:
    """SHA-256 of the sorted lines of a group whose size is bounded."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), "\n"), 256)


def tree_digest(df: DataFrame, line: Column, by: Sequence[str] = (), name: str = "digest") -> DataFrame:
    """One row per key (or one row): number of lines and their digest."""
    hashed = df.select(*by, F.sha2(line, 256).alias("_h"))
    counted = hashed.groupBy(*by, "_h").agg(F.count(F.lit(1)).alias("_n"))
    leaves = counted.select(
        *by, F.substring("_h", 1, 3).alias("_p3"), F.substring("_h", 1, 6).alias("_p6"), "_n",
        F.concat_ws(":", "_h", F.col("_n").cast("string")).alias("_entry"))
    # Placing by (key, first three digits) serves both levels below with a single shuffle.
    placed = leaves.repartition(*by, "_p3")
    lower = placed.groupBy(*by, "_p3", "_p6").agg(hash_lines("_entry").alias("_d"), F.sum("_n").alias("_n"))
    lower = lower.withColumn("_entry", F.concat_ws(":", "_p6", "_d"))
    middle = lower.groupBy(*by, "_p3").agg(hash_lines("_entry").alias("_d"), F.sum("_n").alias("_n"))
    middle = middle.withColumn("_entry", F.concat_ws(":", "_p3", "_d"))
    return middle.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_lines"),
                                   hash_lines("_entry").alias(name))


def tree_parts(df: DataFrame, line: str, kind: str, by: Sequence[str], wanted: Column, kinds: str) -> DataFrame:
    """``*by, part, n, entry``: the branches of the ``tree_digest`` of several overlapping parts of ``df``, whose lines are shuffled once and not once per part.

    ``wanted`` is an array of structs; a part has the lines whose ``kind`` is in the array ``kinds`` of its struct. Hashing the entries of a key and part
    gives its digest. A group holds one branch: 1 of 4,096 of the lines of a key.
    """
    hashed = df.select(*by, F.col(kind).alias("kind"), F.sha2(line, 256).alias("h"))
    placed = hashed.withColumn("_p3", F.substring("h", 1, 3)).repartition(*by, "_p3")
    leaves = placed.groupBy(*by, "_p3", F.substring("h", 1, 6).alias("p6")).agg(F.collect_list(F.struct("kind", "h")).alias("lines"))
    branches = leaves.groupBy(*by, "_p3").agg(F.collect_list(F.struct("p6", "lines")).alias("_leaves"))
    each = branches.withColumn("_wanted", wanted).select(*by, "_p3", "_leaves", F.explode("_wanted").alias("part"))
    hashes = lambda leaf: F.transform(F.filter(leaf["lines"], lambda x: F.array_contains(F.col(f"part.{kinds}"), x["kind"])), lambda x: x["h"])
    own = F.filter(F.transform("_leaves", lambda leaf: F.struct(leaf["p6"].alias("p6"), F.sort_array(hashes(leaf)).alias("h"))), lambda leaf: F.size(leaf["h"]) > 0)
    # Exploded, so that the condition does not compute it once more.
    found = each.select(*by, "_p3", "part", F.explode(F.array(own)).alias("_own")).where(F.size("_own") > 0)
    one = lambda x, n: F.concat_ws(":", x, n.cast("string"))
    # Copies of a line are counted; most leaves have one line.
    counted = lambda h: F.when(F.size(h) == 1, F.transform(h, lambda x: one(x, F.lit(1)))).otherwise(
        F.transform(F.array_distinct(h), lambda x: one(x, F.size(F.filter(h, lambda y: y == x)))))
    text = lambda entries: F.sha2(F.array_join(F.sort_array(entries), "\n"), 256)
    lower = F.transform("_own", lambda leaf: F.concat_ws(":", leaf["p6"], text(counted(leaf["h"]))))
    size = F.aggregate("_own", F.lit(0).cast("bigint"), lambda n, leaf: n + F.size(leaf["h"]))
    return found.select(*by, "part", size.alias("n"), F.concat_ws(":", "_p3", text(lower)).alias("entry"))


def member_sums(df: DataFrame, line: Column, by: Sequence[str] = (), positive: Column | None = None) -> DataFrame:
    """Per key: members (``n_members``), positives among them (``n_pos``) and lane sums (``lanes``).

    A lane adds 16-bit numbers, so 64-bit sums hold for 10**14 members.
    """
    marked = F.lit(False) if positive is None else positive
    hashed = df.select(*by, F.sha2(line, 256).alias("_h"), marked.alias("_p"))
    pieces = [F.conv(F.substring("_h", 4 * i + 1, 4), 16, 10).cast("bigint") for i in range(LANES)]
    return hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("n_members"), F.count_if("_p").alias("n_pos"),
                                   F.array(*[F.coalesce(F.sum(p), F.lit(0)) for p in pieces]).alias("lanes"))


def add_members(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums of sums, for a coarser key."""
    lanes = F.array(*[F.sum(F.col("lanes")[i]) for i in range(LANES)])
    return sums.groupBy(*by).agg(F.sum("n_members").alias("n_members"), F.sum("n_pos").alias("n_pos"), lanes.alias("lanes"))


def minus_lanes(whole: Column, *parts: Column) -> Column:
    def lane(i: int) -> Column:
        value = whole[i]
        for part in parts:
            value = value - part[i]
        return value

    return F.array(*[lane(i) for i in range(LANES)])


def sums_digest(count: Column, lanes: Column) -> Column:
    return F.sha2(F.concat_ws(",", count.cast("string"), lanes.cast("array<string>")), 256)
