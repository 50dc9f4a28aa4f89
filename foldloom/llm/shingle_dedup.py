"""Near-duplicates by SimHash and exact shingle similarity: documents are linked when their sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints over 5-word shingles that differ in 3 bits at most (``simhash_dedup``) are looked up first, and what they link is checked on the texts. Similar texts
may be further apart in bits, so an exact join looks for the links that fingerprints miss, and no link is left to chance. Shingles have one order, rarest first; of two sets of that similarity the first n - ceil(0.8 n) + 1 of each
share one (prefix filter). Lengths, places in the order and 512 parity bits bound what the sets can share: two sets differ in as many
shingles at least as their parities differ in bits. What passes is verified on the texts. First every document meets one hub for each of its prefix
shingles; only documents that this leaves in different components meet each other, so a group of copies costs its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.llm.batches import raw_texts, release_memory
from foldloom.llm.components import components
from foldloom.llm.simhash_dedup import LOWER, SEED, fingerprints, near_duplicate_classes, near_pairs
from foldloom.plans.stage import collect_garbage, drop_staged, stage

SIZE = 5
# The order takes frequencies from one document in so many; a shingle is frequent from so many of these on, and at most so many are told apart.
# None of the three has a part in the result, as any order finds the same pairs.
SAMPLED, FREQUENT, MAX_FREQUENT = 32, 8, 200_000
# 64-bit words of a parity signature.
PARITY = 8
# Pairs whose two texts are copied out of a batch at once.
SLICE = 500


def shingles(raw: bytes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; a text of fewer words is one shingle, one without words has none."""
    words = [w for w in raw.translate(LOWER).split(b" ") if w]
    if not words:
        return np.zeros(0, dtype=np.int64)
    parts = [words] if len(words) <= SIZE else zip(*(words[i:] for i in range(SIZE)))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts], dtype=np.uint64).view(np.int64))


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bit b is the parity of the number of shingles whose hash ends in b."""
    odd = np.bincount(hashes & (64 * PARITY - 1), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def node_of(text: str) -> Column:
    """Equal texts are one node, and so are all texts without words."""
    return F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def frequent(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the shingles that are frequent in a sample."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in raw_texts(batch, text):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(raw))], names=["token"])

    some = df.select(text).where(F.pmod(F.xxhash64(F.lit(1), text), F.lit(SAMPLED)) == 0)
    counts = some.mapInArrow(step, "token long").groupBy("token").count().where(F.col("count") >= FREQUENT)
    found = sorted((r["token"], r["count"]) for r in counts.orderBy(F.desc("count"), "token").limit(MAX_FREQUENT).collect())
    return np.array([t for t, _ in found], dtype=np.int64), np.array([n for _, n in found], dtype=np.int64)


def sketches(df: DataFrame, text: str) -> DataFrame:
    """(node, n, rare, prefix, bits) of every distinct text with words: its number of shingles and of those not frequent, prefix and parity."""
    known, counts = frequent(df, text)

    def sketch(raw: bytes) -> tuple:
        own = shingles(raw)
        count = np.zeros(len(own), dtype=np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            count = np.where(known[at] == own, counts[at], 0)
        prefix = own[np.lexsort((own, count))][:len(own) + (-4 * len(own)) // 5 + 1]
        return len(own), int((count == 0).sum()), prefix, parity(own)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rare, prefix, bits = zip(*map(sketch, raw_texts(batch, text)), strict=True) if batch.num_rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(rare, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                names=["node", "n", "rare", "prefix", "bits"])
        release_memory()

    rows = df.select(node_of(text).alias("node"), text).where("node <> 0")
    return rows.mapInArrow(step, "node long, n int, rare int, prefix array<long>, bits array<long>").dropDuplicates(["node"])


def plausible(pairs: DataFrame, made: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, ...) whose parities leave room for the similarity."""
    side = lambda c: made.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    apart = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return stage(pairs.join(side("a"), "a").join(side("b"), "b").where(9 * apart <= F.col("na") + F.col("nb")).select(*pairs.columns))


def similar(close: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """Those of the distinct pairs (a, b) whose texts have the similarity."""
    nodes = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = stage(df.select(node_of(text).alias("node"), F.col(text).alias("text")).join(nodes, "node", "left_semi").dropDuplicates(["node"]))
    both = close.join(texts.withColumnsRenamed({"node": "a", "text": "x"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "y"}), "b")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, last = [], (None, None)
            for part in (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE)):
                for b, x, y in zip(part.column(1).to_pylist(), raw_texts(part, "x"), raw_texts(part, "y"), strict=True):
                    last = last if last[0] == b else (b, shingles(y))  # the join leaves the pairs of a hub together
                    one, two = shingles(x), last[1]
                    kept.append(9 * len(np.intersect1d(one, two, assume_unique=True)) >= 4 * (len(one) + len(two)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))
        release_memory()

    found = stage(both.select("a", "b", "x", "y").mapInArrow(step, "a long, b long"))
    drop_staged(close, texts)
    return found


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet; a node without a root is alone."""
    end = lambda c: roots.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"_root_{c}"))
    met = pairs.join(end("a"), F.col("a") == F.col("_a"), "left").join(end("b"), F.col("b") == F.col("_b"), "left")
    return stage(met.where(F.coalesce("_root_a", "a") != F.coalesce("_root_b", "b")).select(*pairs.columns))


def fingerprint_pairs(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Links of fingerprints as pairs (a, b) of nodes: of each node with the smallest of its fingerprint, and of these with those of near fingerprints.

    The first table has one pair a node at most, among them one with a near fingerprint for each that has any: a group of copies is joined at the cost of its
    size. The second has all pairs of near fingerprints.
    """
    prints = stage(fingerprints(df.select(node_of(text).alias("node"), text).where("node <> 0"), text, "print", keep=["node"], size=SIZE).distinct())
    hubs = prints.groupBy("print").agg(F.min("node").alias("hub"))
    end = lambda c: hubs.select(F.col("print").alias(f"_{c}"), F.col("hub").alias(c))
    met = near_pairs(prints, "print").withColumnsRenamed({"a": "_a", "b": "_b"})
    near = stage(met.join(end("a"), "_a").join(end("b"), "_b").select("a", "b"))
    own = prints.join(hubs, "print").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    first = stage(own.unionByName(near.groupBy("a").agg(F.min("b").alias("b"))))
    drop_staged(prints)
    return first, near


def with_token(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rows that have one of ``tokens``. Sorted, never broadcast: hashed in the driver, a token takes ten times the bytes it has in its file."""
    return rows.join(tokens.hint("merge"), "token", "left_semi")


def similar_pairs(df: DataFrame, text: str = "text") -> DataFrame:
    """(a, b): links between nodes that join exactly those nodes which a chain of similar pairs joins.

    Texts travel to be compared, so pairs are compared in turns, each without the pairs that the turns before have joined: those of equal and near fingerprints, then
    every document with the hub that it shares most shingles with, then with its other hubs, then documents with each other.
    """
    nearest, near = fingerprint_pairs(df, text)
    copies = similar(nearest, df, text)
    roots = components(copies)
    met = apart(near, roots)
    drop_staged(near)
    made = stage(sketches(df, text))
    tokens = made.select("node", "n", "rare", F.posexplode("prefix").alias("at", "token"))
    room = lambda m, at: (5 * F.least("n", m) >= 4 * F.greatest("n", m)) & (9 * F.least(F.col("n") - F.col("at"), m - at) >= 4 * (F.col("n") + m))
    # The hub of a shingle is the document with the fewest shingles of its own: of a group of copies rather the one they come from.
    # Most shingles occur once and link nothing, so they are counted on their own before anything is kept.
    repeated = stage(tokens.groupBy("token").count().where("count > 1").select("token"))
    shared = stage(with_token(tokens, repeated))
    hubs = stage(shared.groupBy("token").agg(F.min(F.struct("rare", "node", "n", "at")).alias("hub")))
    hub = F.col("hub")
    with_hubs = shared.drop("rare").join(hubs, "token").where((F.col("node") != hub["node"]) & room(hub["n"], hub["at"]))
    close = plausible(with_hubs.groupBy(F.col("node").alias("a"), hub["node"].alias("b")).agg(F.count(F.lit(1)).alias("shared")), made)
    former, close = close, apart(close, roots)
    drop_staged(former, roots)
    best = stage(close.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b")).unionByName(met).distinct())
    drop_staged(met)
    linked = copies.unionByName(similar(best, df, text))
    roots = components(linked)
    second = similar(apart(close.select("a", "b"), roots), df, text)
    drop_staged(repeated, hubs, close, roots)
    linked = linked.unionByName(second)
    roots = components(linked)
    placed = stage(shared.drop("rare").join(roots.withColumnRenamed("node", "v"), F.col("node") == F.col("v"), "left").select("token", "node", "n", "at", F.coalesce("root", "node").alias("root")))
    drop_staged(shared, roots)
    open_tokens = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    left = stage(with_token(placed, open_tokens))
    drop_staged(placed)
    other = left.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("at").alias("bt"), F.col("root").alias("other"))
    rest = left.join(other, "token").where((F.col("node") < F.col("b")) & (F.col("root") != F.col("other")) & room(F.col("m"), F.col("bt")))
    third = similar(plausible(rest.select(F.col("node").alias("a"), "b").distinct(), made), df, text)
    drop_staged(made, left)
    return linked.unionByName(third)


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates with all its columns: that of the smallest key, then of the smallest row hash.

    Null keys come last. Of rows that repeat key and text one stays. Texts without words are one group.
    """
    collect_garbage(df.sparkSession)
    row = F.xxhash64(key, text)
    rows = stage(df.select(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), row.alias("row")).alias("rank"), node_of(text).alias("__text")))
    classes = near_duplicate_classes(rows, "rank", "__text", similar_pairs(df, text))
    kept = classes.select(F.col("component_id")["row"].alias("__kept"), F.col("component_id")["key"].alias("__key")).distinct()
    found = df.withColumn("__row", row).join(kept, (F.col("__row") == F.col("__kept")) & F.col(key).eqNullSafe(F.col("__key")), "left_semi")
    return found.dropDuplicates(["__row", key]).drop("__row")
