"""SimHash near-duplicates by multi-index hashing.

Documents become 64-bit fingerprints, equal fingerprints become one. Of two fingerprints within 3 bits, one of the two 32-bit halves
differs in at most one bit. So every fingerprint stands in a table under each half, and asks for its own half and for the halves one bit
away. Only bits set from 0 to 1 are tried: of two halves one bit apart exactly one has the 0. Whole distances are verified.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldloom.llm.batches import extended, raw_texts, release_memory, with_columns
from foldloom.llm.components import components
from foldloom.plans.stage import stage

# A-Z become a-z; words end at spaces and the control characters from 9 to 13.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
SEED = 42
MASK = (1 << 32) - 1
# Shingles whose bits are counted at once.
CHUNK = 100_000


def fingerprint(raw: bytes, size: int = 3) -> int:
    """The fingerprint of a text as a signed 64-bit number; 0 without words."""
    words = [w for w in raw.translate(LOWER).split(b" ") if w]
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(part), SEED) for part in zip(*(words[i:] for i in range(size)))]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.array(hashes[at:at + CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "simhash", keep: Iterable[str] | None = None, size: int = 3) -> DataFrame:
    """Adds the fingerprint of each whole text, over its shingles of ``size`` words. Null and empty texts get 0; an existing column ``out`` is replaced."""
    passed, schema = extended(df, keep, [T.StructField(out, T.LongType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield with_columns(batch, passed, {out: pa.array([fingerprint(raw, size) for raw in raw_texts(batch, text)], pa.int64())})
        release_memory()

    return df.select(*dict.fromkeys([*passed, text])).mapInArrow(step, schema)


def near_pairs(prints: DataFrame, out: str = "simhash") -> DataFrame:
    """(a, b) with a < b for all distinct fingerprints that differ in 1 to 3 bits, each pair once."""
    own = prints.select(F.col(out).alias("f")).where("f is not null").distinct()
    halves = lambda f: (F.shiftrightunsigned(F.col(f), 32), F.col(f).bitwiseAND(F.lit(MASK)))
    table = own.select("f", F.posexplode(F.array(*halves("f"))).alias("half", "value"))
    probes = table.select(F.col("f").alias("g"), "half", F.explode(F.concat(
        F.array("value"), F.filter(F.array(*[F.col("value").bitwiseOR(F.lit(1 << bit)) for bit in range(32)]), lambda v: v != F.col("value"))
    )).alias("value"), F.col("value").alias("from"))
    # Spark does not see that the explode makes about 17 probes of a half, and would broadcast them.
    # Equal halves are met from both sides: one is enough.
    met = table.join(probes.hint("merge"), ["half", "value"]).where("f <> g and (value <> `from` or f < g)")
    first = F.bit_count(F.shiftrightunsigned(F.col("f").bitwiseXOR(F.col("g")), 32))
    return (met.where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= 3)
            .where((F.col("half") == 0) | (first > 1))  # pairs close in both halves come from the first
            .select(F.least("f", "g").alias("a"), F.greatest("f", "g").alias("b")))


def near_duplicate_classes(prints: DataFrame, key: str = "doc_id", out: str = "simhash", pairs: DataFrame | None = None) -> DataFrame:
    """(``out``, component_id): for each fingerprint the smallest ``key`` reachable over ``pairs`` (a, b), by default links of at most 3 bits.

    ``prints`` is read twice: hand over a written table. Null keys have no part in the minimum; a component of null keys only has a null id.
    """
    least = prints.groupBy(out).agg(F.min(key).alias("least"))
    roots = components(near_pairs(prints, out) if pairs is None else pairs)
    joined = stage(least.join(roots, least[out] == roots["node"], "left").select(out, "least", "root"))
    linked = joined.where("root is not null")
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return (linked.join(best, "root").select(out, "component_id")
            .unionByName(joined.where("root is null").select(out, F.col("least").alias("component_id"))))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, simhash, component_id) for every row: rows are linked when their fingerprints differ in at most 3 bits.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null key are kept. Repeated rows give repeated rows.
    An empty table gives an empty result.
    """
    prints = stage(fingerprints(df, text, keep=[key]))
    return prints.join(near_duplicate_classes(prints, key), "simhash").select(key, "simhash", "component_id")


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate group with all its columns: that of the smallest key, then of the smallest row hash.

    Null keys come last. Of rows that repeat key and text one stays.
    """
    rows = stage(fingerprints(df.withColumn("__row", F.xxhash64(key, text)), text, "__print", keep=[key, "__row"]))
    classes = near_duplicate_classes(rows.select(F.struct(F.col(key).isNull().alias("last"), key, "__row").alias("rank"), "__print"), "rank", "__print")
    kept = classes.select(F.col("component_id")["__row"].alias("__kept"), F.col("component_id")[key].alias("__key")).distinct()
    found = df.withColumn("__row", F.xxhash64(key, text)).join(
        kept, (F.col("__row") == F.col("__kept")) & F.col(key).eqNullSafe(F.col("__key")), "left_semi")
    return found.dropDuplicates(["__row", key]).drop("__row")
