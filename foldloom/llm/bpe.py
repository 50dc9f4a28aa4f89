"""Byte-level BPE by merge replay: one block of the corpus is merged at once, in rank order, over an inverted index.

``encode`` splits texts by a pattern, takes the distinct words of a block of documents that are not known yet, and replays the
merges on all of them together: an inverted index maps what a token pair merges into to the positions of that pair; the
lowest rank is applied at all its positions, and only the two neighbours of a position get new index entries. A block is an
Arrow batch, so memory is bounded, nothing is shuffled and a lost task is redone from its input split.
``decode`` turns ids back into bytes.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foldloom.llm.batches import extended, raw_texts, release_memory, with_columns

# A space beside other white space. Elsewhere each single space starts a new word, whatever stands around it.
LOOSE_SPACE = re.compile(r" \s|\s ")
# Bound of the word memory of one task, beyond which only words that came again stay; words merged at once.
MEMORY_WORDS, REPLAY_WORDS = 250_000, 50_000
# White space that the library's pattern matcher need not manage.
LONG_SPACE = re.compile(r"\s{1000}")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file with one base64 token and rank a line. The vocabulary is bounded by its file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Replay:
    """The merges of one vocabulary. A pair's rank is the rank of its joined bytes, however the bytes are divided."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.bits = max(ranks.values()).bit_length() + 1
        self.end = 1 << (self.bits - 1)  # stands between words and pairs with nothing
        merged = {ranks[t[:i]] << self.bits | ranks[t[i:]]: rank for t, rank in ranks.items()
                  for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = np.array(sorted(merged), dtype=np.int64)
        self.ranks = np.array([merged[p] for p in self.pairs.tolist()], dtype=np.int32)

    def rank_of(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """Rank of each pair, -1 for pairs that never merge."""
        pair = np.left_shift(left, self.bits, dtype=np.int64) | right
        place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[place] == pair, self.ranks[place], np.int32(-1))

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of every word: merges in rank order, equal ranks from left to right, within each word."""
        if not words:
            return []
        sizes = np.array([len(word) for word in words])
        starts = np.cumsum(sizes + 1) - sizes
        text = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", dtype=np.uint8)
        token = self.byte_ids[text]
        token[0] = token[starts + sizes] = self.end
        after, before = np.arange(1, len(token) + 1, dtype=np.int32), np.arange(-1, len(token) - 1, dtype=np.int32)
        pair = np.append(self.rank_of(token[:-1], token[1:]), np.int32(-1))  # rank of the pair that begins at each position
        alive = token != self.end
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            edges = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)]
            for a, b in zip(edges, edges[1:]):
                rank = int(ranks[a])
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(heap, rank)
                index[rank].append(places[a:b])

        first = np.flatnonzero(pair >= 0).astype(np.int32)
        if len(first):
            enter(first, pair[first])
        odd: list[np.ndarray] = []
        while heap:
            rank = heapq.heappop(heap)
            at = np.concatenate(index.pop(rank))
            at = np.sort(at[pair[at] == rank])
            if not len(at):
                continue
            at = at[np.append(True, at[1:] != at[:-1])]
            gone = after[at]
            chained = gone[:-1] == at[1:]
            if chained.any():  # pairs that share a token: every other one of a chain merges
                head = np.append(True, ~chained)
                turn = np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]
                at, gone = at[turn % 2 == 0], gone[turn % 2 == 0]
            token[at] = rank
            pair[gone], alive[gone] = -1, False
            right = after[gone]
            after[at], before[right] = right, at
            left = before[at]
            pair[at] = self.rank_of(rank, token[right])
            pair[left] = self.rank_of(token[left], rank)
            touched = np.concatenate([at, left])
            found = pair[touched]
            touched, found = touched[found >= 0], found[found >= 0]
            if len(touched):
                if found.min() <= rank:
                    odd.append(touched[found <= rank])
                enter(touched, found)
        flat = token[alive].astype("<u4").tobytes()
        ends = 4 * np.cumsum(alive)[starts + sizes]
        packed = [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        # A merge that brings up a lower or equal rank must go on there before its word's next place: one word at a time.
        for word in np.unique(np.searchsorted(starts, np.concatenate(odd), "right") - 1).tolist() if odd else ():
            packed[word] = self.alone(words[word])
        return packed

    def alone(self, word: bytes) -> bytes:
        """Packed ids of one word, by always merging the first pair of lowest rank."""
        token = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before = [*range(1, len(token)), -1], list(range(-1, len(token) - 1))
        rank_of = lambda at: int(self.rank_of(token[at], token[after[at]])) if after[at] >= 0 else -1
        heap = [(rank, at) for at in range(len(token)) if (rank := rank_of(at)) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            if token[at] < 0 or rank_of(at) != rank:
                continue
            gone = after[at]
            token[at], token[gone], after[at] = rank, -1, after[gone]
            if after[at] >= 0:
                before[after[at]] = at
            for place in (before[at], at):
                if place >= 0 and (found := rank_of(place)) >= 0:
                    heapq.heappush(heap, (found, place))
        return np.array([t for t in token if t >= 0], "<u4").tobytes()


class Encoder:
    """Encodes the blocks of one task. Words and their ids are remembered up to a bound, and no longer than the task runs.

    With ``library`` texts go to the tiktoken library, which gives the same ids; those with a long run of white space stay with the replay, since the
    library's pattern matcher fails on them.
    """

    def __init__(self, replay: Replay, pattern: str, library: tiktoken.Encoding | None = None):
        self.replay, self.pattern, self.library = replay, regex.compile(pattern), library
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> tuple[list[str], list[str]]:
        """Words that open the text, and words that follow a single space each (written without it).

        The pattern always starts a word at a space between two other characters, so such a text can be cut there first. Texts
        with other runs of white space are split by the pattern alone.
        """
        if LOOSE_SPACE.search(text):
            return self.pattern.findall(text), []
        first, *rest = text.split(" ")
        return self.pattern.findall(first), rest

    def __call__(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.library is None:
            return self.by_words(texts)
        texts = list(texts)
        fit = [LONG_SPACE.search(text) is None for text in texts]
        others = iter(self.by_words([text for text, fits in zip(texts, fit, strict=True) if not fits]))
        ids_of = self.library.encode_ordinary
        return [array("I", ids_of(text)).tobytes() if fits else next(others) for text, fits in zip(texts, fit, strict=True)]

    def by_words(self, texts: Iterable[str]) -> list[bytes]:
        cut = [self.pieces(text) for text in texts]
        # Opening words are kept behind two spaces: a piece holds no space, so the two kinds never clash.
        spaced = set().union(*(rest for _, rest in cut))
        opening = {"  " + word for first, _ in cut for word in first}
        if len(self.known) > MEMORY_WORDS:
            self.known = {piece: self.known[piece] for own in (spaced, opening) for piece in own if piece in self.known}
        spaced, opening = spaced.difference(self.known), opening.difference(self.known)
        split = {piece: self.pattern.findall(" " + piece) for piece in spaced} | {piece: [piece[2:]] for piece in opening}
        words = list({word for parts in split.values() for word in parts})
        packed: dict[str, bytes] = {}
        for at in range(0, len(words), REPLAY_WORDS):
            part = words[at:at + REPLAY_WORDS]
            packed.update(zip(part, self.replay([word.encode() for word in part])))
        self.known.update((piece, b"".join(map(packed.__getitem__, parts))) for piece, parts in split.items())
        known = self.known.__getitem__
        return [b"".join(known("  " + word) for word in first) + b"".join(map(known, rest)) for first, rest in cut]


@cache
def _replay(path: str) -> Replay:
    return Replay(read_ranks(path))


@cache
def _library(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@cache
def _token_bytes(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def blocks(batches: Iterator[pa.RecordBatch], name: str, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column ``name`` has about ``size`` bytes at most, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


def _bytes_of(packed: list[bytes], path: str) -> list[bytes]:
    piece: Callable[[int], bytes] = _token_bytes(path).__getitem__
    return [b"".join(map(piece, np.frombuffer(raw, "<u4").tolist())) for raw in packed]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids",
           keep: Iterable[str] | None = None, library: bool = False, decoded: str | None = None) -> DataFrame:
    """Adds ``ids``: the token ids of the whole text as packed little-endian unsigned 32-bit integers (binary).

    ``path``: rank file, readable on every machine. ``keep``: columns that pass through (default: all). ``library``: merge
    with the tiktoken library instead of the replay; the ids are the same. ``decoded``: adds a column of that name with the bytes that
    ``decode`` makes of the ids, in the same Python worker. A null or empty text has no
    ids; bytes that are no UTF-8 are read as U+FFFD. Repeated rows are encoded alike; an existing column ``ids`` is replaced.
    """
    passed, schema = extended(df, keep, [T.StructField(c, T.BinaryType()) for c in (ids, decoded) if c])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_replay(path), pattern, _library(path, pattern) if library else None)
        for batch in blocks(batches, text):
            packed = encoder(raw.decode("utf-8", "replace") for raw in raw_texts(batch, text))
            added = {ids: pa.array(packed, pa.binary())}
            if decoded:
                added[decoded] = pa.array(_bytes_of(packed, path), pa.binary())
            yield with_columns(batch, passed, added)
            del packed, added
            release_memory()
        del encoder
        release_memory()

    return df.select(*dict.fromkeys([*passed, text])).mapInArrow(step, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded", keep: Iterable[str] | None = None) -> DataFrame:
    """Adds ``out``: the bytes that the packed ids in ``ids`` stand for. Null ids give no bytes; an unknown id raises."""
    passed, schema = extended(df, keep, [T.StructField(out, T.BinaryType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, ids):
            yield with_columns(batch, passed, {out: pa.array(_bytes_of(raw_texts(batch, ids), path), pa.binary())})
        release_memory()

    return df.select(*dict.fromkeys([*passed, ids])).mapInArrow(step, schema)
