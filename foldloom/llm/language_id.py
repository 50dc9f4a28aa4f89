"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams of a language, in order. A document gets its own list; every n-gram of it adds the distance
between its two places (out-of-place distance), or the profile's size when the language lacks it. The nearest language wins.
Texts are read as letters: lower case, everything else becomes one space, n-grams of 1 to 3 characters do not reach over spaces.
N-grams are numbers (21 bits a character), so one sort per document counts them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldloom.llm.batches import extended, raw_texts, release_memory, with_columns

UNKNOWN = "und"
BITS = 21
# Languages whose profiles may be sent to every task; more are refused, since the table grows with them.
MAX_LANGUAGES = 2_000
# Characters whose n-grams are sorted at once while learning.
CHUNK = 200_000
# N-grams held by a task before it passes their counts on.
HELD = 1_000_000


@cache
def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or a space for what is no letter."""
    table = np.full(0x110000, 32, dtype=np.int64)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = ord(char.lower()[0])
    return table


def letters(raw: bytes) -> np.ndarray:
    """Letters of a text with single spaces between and around its words; empty if it has no letter."""
    codes = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
    own = np.concatenate([[32], _letters()[codes], [32]])
    kept = own[np.append(True, (own[1:] != 32) | (own[:-1] != 32))]
    return kept if len(kept) > 1 else kept[:0]


def ngrams(own: np.ndarray) -> np.ndarray:
    """All n-grams of 1 to 3 characters: single letters, pairs and triples with a space only at their ends."""
    if len(own) < 3:
        return own[:0]
    pairs = own[:-1] << BITS | own[1:]
    triples = (pairs[:-1] << BITS | own[2:])[own[1:-1] != 32]
    return np.concatenate([own[own != 32], pairs, triples])


def ranked(own: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams in order; equal counts by number."""
    found, counts = np.unique(ngrams(own), return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Ranks of every profile n-gram in each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.names, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([np.array(p, dtype=np.int64) for p in profiles.values()] + [np.empty(0, np.int64)]))
        self.rank = np.full((len(self.grams) + 1, len(self.names)), -1, dtype=np.int64)  # the last row stands for other n-grams
        for column, name in enumerate(self.names):
            self.rank[np.searchsorted(self.grams, profiles[name]), column] = np.arange(len(profiles[name]))

    def nearest(self, raw: bytes) -> tuple[str, float]:
        """The language and 1 - distance / largest distance; ties go to the first name."""
        own = ranked(letters(raw), self.size)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        place = np.searchsorted(self.grams, own)
        place[place == len(self.grams)] = 0
        place = np.where(self.grams[place] == own, place, len(self.grams)) if len(self.grams) else place
        rank = self.rank[place]
        distance = np.where(rank >= 0, np.abs(rank - np.arange(len(own))[:, None]), self.size).sum(axis=0)
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best] / (self.size * len(own)))


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = 400) -> DataFrame:
    """(lang, gram, position): the ``size`` most frequent n-grams over all given documents of each language.

    Tasks count in chunks, the sums meet by n-gram, and only ``size`` rows a language survive each sorted part before they are ranked.
    Documents without text or language teach nothing.
    """
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        waiting: dict[str, int] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold(name: str) -> None:
            grams, counts = sums.get(name, (np.empty(0, np.int64), np.empty(0, np.int64)))
            found, times = np.unique(np.concatenate([ngrams(x.astype(np.int64)) for x in held.pop(name)]), return_counts=True)
            keys, where = np.unique(np.concatenate([grams, found]), return_inverse=True)
            total = np.bincount(where, weights=np.concatenate([counts, times]), minlength=len(keys)).astype(np.int64)
            sums[name], waiting[name] = (keys, total), 0

        def out() -> Iterator[pa.RecordBatch]:
            for name, (grams, counts) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                                                 names=["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            for raw, name in zip(raw_texts(batch, "text"), batch.column(1).to_pylist()):
                held.setdefault(name, []).append(own := letters(raw).astype(np.uint32))
                waiting[name] = waiting.get(name, 0) + len(own)
                if waiting[name] > CHUNK:
                    fold(name)
            if sum(len(g) for g, _ in sums.values()) > HELD:
                yield from out()
        for name in list(held):
            fold(name)
        yield from out()
        release_memory()

    counts = (docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
              .mapInArrow(step, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # Two rounds keep the ranking of one language out of a single task: the first in 64 parts, the second over their survivors.
    order = (F.desc("n"), F.asc("gram"))
    parts = counts.withColumn("part", F.pmod("gram", F.lit(64)))
    best = parts.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("r") <= size)
    return (best.withColumn("position", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
            .where(F.col("position") <= size).select("lang", "gram", "position"))


def collect_profiles(profiles: DataFrame) -> dict[str, list[int]]:
    """Profiles by language, in order. At most ``MAX_LANGUAGES`` times the profile size numbers come to the driver."""
    rows = profiles.limit(MAX_LANGUAGES * 1_000 + 1).collect()
    found: dict[str, list[tuple[int, int]]] = {}
    for row in rows:
        found.setdefault(row["lang"], []).append((row["position"], row["gram"]))
    if len(found) > MAX_LANGUAGES or len(rows) > MAX_LANGUAGES * 1_000:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {name: [gram for _, gram in sorted(own)] for name, own in found.items()}


def identify(df: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = 400,
             keep: Iterable[str] | None = None) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to every row, from its whole text alone.

    A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned. Repeated rows are
    judged alike, ties go to the first language by name, existing columns of the added names are replaced.
    """
    passed, schema = extended(df, keep, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(profiles)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Profiles(shared.value, size)
        for batch in batches:
            found = [table.nearest(raw) for raw in raw_texts(batch, text)]
            yield with_columns(batch, passed, {"lang_pred": pa.array([name for name, _ in found], pa.string()),
                                               "score": pa.array([score for _, score in found], pa.float64())})
        release_memory()

    return df.select(*dict.fromkeys([*passed, text])).mapInArrow(step, schema)
