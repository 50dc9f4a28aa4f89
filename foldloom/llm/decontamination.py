"""Benchmark decontamination with a generalised suffix automaton over the words of all benchmark items.

The automaton accepts every run of consecutive words of one item. Streaming a document's words through it gives, at each word, the
longest run ending there that some item contains. A run of ``window`` words, or a whole item shorter than that, is a hit; hit
words are merged into spans. Every document is judged on its own, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldloom.llm.batches import WORD_TABLE, extended, raw_texts, with_columns, words_of
from foldloom.plans.stage import drop_staged, stage

# Characters of the items that one automaton may hold. Larger benchmarks are judged shard by shard, with the hits of all shards merged.
MAX_ITEM_CHARACTERS = 40_000_000
ADDED = ("n_words", "n_hit", "n_items", "items", "hit_spans", "contaminated")
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


class Automaton:
    """States hold classes of word runs; ``link`` leads to the longest suffix in another class."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        shortest = window
        ends = []  # (state, words in the window, item)
        whole: set[int] = set()
        for name, words in items:
            if not words:
                continue
            shortest = min(shortest, len(words))
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            last = 0
            for code in codes:
                last = self._extend(last, code)
            ends.append((name, codes))
        self.shortest = shortest
        # Items of each window, kept at the state that holds the window.
        self.items: dict[int, set[str]] = {}
        for name, codes in ends:
            if len(codes) < window:
                state = 0
                for code in codes:
                    state = self.next[state][code]
                whole.add(state)
                self.items.setdefault(state, set()).update([name] if name is not None else [])
            else:
                state, matched = 0, 0
                for code in codes:
                    state, matched = self.step(state, matched, code)
                    if matched >= window:
                        at = self.suffix(state, window)
                        self.items.setdefault(at, set()).update([name] if name is not None else [])
        # The nearest shorter suffix that is a whole short item.
        self.short = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[state]
            self.short[state] = up if up in whole else self.short[up] if up > 0 else -1
        self.whole = whole

    def _extend(self, last: int, code: int) -> int:
        """The state of the item's words so far with one word more."""
        known = self.next[last].get(code)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, code, known)
        state = self._new(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and code not in self.next[at]:
            self.next[at][code] = state
            at = self.link[at]
        if at >= 0:
            known = self.next[at][code]
            self.link[state] = known if self.length[known] == self.length[at] + 1 else self._split(at, code, known)
        return state

    def _split(self, at: int, code: int, known: int) -> int:
        """A state of its own for the shorter runs of ``known`` that end with ``code`` behind ``at``."""
        copy = self._new(self.length[at] + 1, dict(self.next[known]), self.link[known])
        self.link[known] = copy
        while at >= 0 and self.next[at].get(code) == known:
            self.next[at][code] = copy
            at = self.link[at]
        return copy

    def _new(self, length: int, steps: dict[int, int], link: int) -> int:
        self.next.append(steps)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def step(self, state: int, matched: int, code: int) -> tuple[int, int]:
        """The longest known run that ends with this word: its state and number of words."""
        while state > 0 and code not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        target = self.next[state].get(code)
        return (target, matched + 1) if target is not None else (0, 0)

    def suffix(self, state: int, size: int) -> int:
        """The state that holds the last ``size`` words of a run in ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit spans (start, length) of a text's words, and the items whose windows occur."""
        spans: list[list[int]] = []
        found: set[int] = set()
        state = matched = 0
        for at, code in self._runs(words):
            if code is None:
                state = matched = 0
                continue
            state, matched = self.step(state, matched, code)
            size = 0
            if matched >= self.window:
                size = self.window
                found.add(self.suffix(state, size))
            short = state if state in self.whole and matched == self.length[state] else self.short[state]
            while short > 0:
                size = max(size, self.length[short])
                found.add(short)
                short = self.short[short]
            if size:
                start = at + 1 - size
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, at + 1])
        return [(a, b - a) for a, b in spans], set().union(*(self.items[s] for s in found))

    def _runs(self, words: list[bytes]) -> Iterator[tuple[int, int | None]]:
        """Positions and codes of runs of known words that are long enough for a window; None ends a run."""
        codes = list(map(self.vocabulary.get, words))
        codes.append(None)
        at = 0
        while at < len(words):
            end = codes.index(None, at)
            if end - at >= self.shortest:
                yield from zip(range(at, end), codes[at:end])
                yield end, None
            at = end + 1


def item_words(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> list[tuple[str | None, list[bytes]]]:
    """Distinct items as words. Their size is checked before they come to the driver; ``decontaminate_by`` takes benchmarks of any size."""
    items = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > MAX_ITEM_CHARACTERS:
        raise ValueError(f"the benchmark has {size} characters; one automaton takes {MAX_ITEM_CHARACTERS}: use decontaminate_by")
    distinct = {(row["name"], row["text"]) for row in items.collect()}
    return [(name, words_of(body.encode())) for name, body in sorted(distinct, key=str)]


def decontaminate(df: DataFrame, items: list[tuple[str | None, list[bytes]]], text: str = "text", window: int = 13, share: int = 20,
                  keep: Iterable[str] | None = None, cleaned: str | None = None, longest: int | None = None, add_to: bool = False) -> DataFrame:
    """Adds n_words, n_hit, n_items, items (sorted names), hit_spans (start and length in words) and contaminated.

    A window is ``window`` consecutive words of an item, or a whole shorter item; words inside any occurrence are hit. A document is
    contaminated if it has a hit and ``share`` * n_hit >= n_words. Null and empty texts have no words and no hits. Items without a
    name still hit but are not counted in n_items; repeated items count once by name. Repeated rows are judged alike. Existing columns of
    the added names are replaced. Without items nothing is hit. ``cleaned`` names a further column: the text without the hit spans that exceed a limit,
    i.e. those of more than ``longest`` words (None: every span), and all spans if the document is contaminated. With ``add_to`` the columns hit_spans and
    items of ``df`` are those found by other items: the result has the hits of both.
    """
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
             T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hit_spans", SPAN),
             T.StructField("contaminated", T.BooleanType())]
    added += [T.StructField(cleaned, T.StringType())] if cleaned else []
    passed, schema = extended(df, keep, added)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    shared = df.sparkSession.sparkContext.broadcast(items)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value, window)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in added}
            former = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in earlier]
            for place, raw in enumerate(raw_texts(batch, text)):
                words = words_of(raw)
                spans, names = automaton.scan(words)
                if earlier:
                    spans, names = merged([*((s["start"], s["length"]) for s in former[0][place]), *spans]), names | set(former[1][place])
                hit = sum(length for _, length in spans)
                bad = hit > 0 and share * hit >= len(words)
                for name, value in zip(out, (len(words), hit, len(names), sorted(names), [{"start": a, "length": n} for a, n in spans], bad)):
                    out[name].append(value)
                if cleaned:
                    gone = spans if bad else [s for s in spans if longest is None or s[1] > longest]
                    out[cleaned].append((remove_spans(raw, gone) if gone else raw).decode("utf-8", "replace"))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), span_type, pa.bool_(), pa.string())
            yield with_columns(batch, passed, {n: pa.array(v, t) for (n, v), t in zip(out.items(), types)})

    earlier = ("hit_spans", "items") if add_to else ()
    return df.select(*dict.fromkeys([*passed, text, *earlier])).mapInArrow(step, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, length) in order, those that overlap or touch as one."""
    out: list[list[int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length - out[-1][0])
        else:
            out.append([start, length])
    return [(a, n) for a, n in out]


def decontaminate_by(df: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", text: str = "text", keep: Iterable[str] | None = None,
                     **settings) -> DataFrame:
    """As ``decontaminate`` for a benchmark table of any size: its items are dealt by hash into shards that one automaton holds, and each shard's pass adds its hits.

    A single item larger than a shard makes a shard of its own and more than ``MAX_ITEM_CHARACTERS`` raises. Passes are written in between, so one automaton is in memory.
    """
    size = benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0
    shards = 1 if size <= MAX_ITEM_CHARACTERS else -(-2 * size // MAX_ITEM_CHARACTERS)
    if shards == 1:
        return decontaminate(df, item_words(benchmark, item_id, item_text), text, keep=keep, **settings)
    last = dict(settings)
    first = {k: v for k, v in settings.items() if k not in ("cleaned", "longest")}
    out, columns = df, [c for c in (df.columns if keep is None else keep) if c not in ADDED]
    for number in range(shards):
        own = item_words(benchmark.where(F.pmod(F.xxhash64(item_text), F.lit(shards)) == number), item_id, item_text)
        final = number == shards - 1
        former, out = out, decontaminate(out, own, text, keep=columns if final else [*dict.fromkeys([*columns, text])], add_to=number > 0, **(last if final else first))
        if not final:
            out = stage(out)
            drop_staged(former)
    return out


def remove_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; what stands between kept words stays."""
    flat, pieces, start, at = raw.translate(WORD_TABLE), [], 0, 0
    bounds = []
    for word in flat.split():
        begin = flat.index(word, at)
        at = begin + len(word)
        bounds.append((begin, at))
    for first, length in spans:
        pieces.append(raw[start:bounds[first][0]])
        start = bounds[first + length - 1][1]
    return b"".join([*pieces, raw[start:]])
