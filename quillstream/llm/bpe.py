"""Encoding of texts with a public byte-level BPE vocabulary, by a pair occurrence index.

The words of a batch are laid out once; every pair of neighbours is indexed by the rank of the token it would make, with
all its positions. Active ranks are then applied in ascending order, each at all its positions at once, and only the
lists of the pairs around a merge are updated. Words met before are kept, up to a bound, so that each is encoded once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's makers cut text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept per worker, and the length in bytes up to which a word is kept.
KEPT_WORDS, KEPT_BYTES = 200_000, 64
#: Pairs of tokens whose rank a worker remembers.
KEPT_PAIRS = 500_000


class Encoder:
    """Encodes batches of texts; vocabulary holds lines of base64 token and rank."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.splitlines()) if t}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        self.kept: dict[str, tuple[int, ...]] = {}

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's token, or -1."""
        keys, back = np.unique(left << 20 | right, return_inverse=True)
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        known, tokens, ranks = self.pairs, self.tokens, self.ranks
        out = np.empty(len(keys), np.int64)
        for i, k in enumerate(keys.tolist()):
            r = known.get(k)
            if r is None:
                r = known[k] = ranks.get(tokens[k >> 20] + tokens[k & 0xFFFFF], -1)
            out[i] = r
        return out[back]

    def words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        ends = np.cumsum(sizes)
        after = np.arange(1, n + 1)
        after[ends - 1] = n  # n: no neighbour
        before = np.arange(-1, n - 1)
        before[np.concatenate(([0], ends[:-1]))] = -1
        alive = np.ones(n, bool)
        rank = np.full(n + 1, -1, np.int64)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Index the pairs that begin at these positions."""
            second = after[at]
            has = second < n
            rank[at[~has]] = -1
            at, second = at[has], second[has]
            if not len(at):
                return
            r = rank[at] = self._pair_ranks(sym[at], sym[second])
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            for k, group in zip(r[starts].tolist(), np.split(at, starts[1:])):
                if k in index:
                    index[k].append(group)
                else:
                    index[k] = [group]
                    heappush(active, k)

        enter(np.arange(n))
        heapify(active)
        while active:
            r = heappop(active)
            at = np.unique(np.concatenate(index.pop(r)))
            at = at[rank[at] == r]
            if len(at) > 1:  # of overlapping places the first, third, ... count
                fresh = np.concatenate(([True], at[1:] != after[at[:-1]]))
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            further = after[gone]
            sym[at] = r
            after[at] = further
            inner = further < n
            before[further[inner]] = at[inner]
            alive[gone] = False
            rank[gone] = -1
            ahead = before[at]
            enter(np.unique(np.concatenate((at, ahead[ahead >= 0]))))
        ids = sym[alive]
        cuts = np.concatenate(([0], np.cumsum(alive)))[ends].tolist()
        flat, start, out = ids.tolist(), 0, []
        for end in cuts:
            out.append(tuple(flat[start:end]))
            start = end
        return out

    def batch(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text; null and empty texts have none."""
        cut = [self.find(t) if t else [] for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        fresh = list(set(chain.from_iterable(cut)) - self.kept.keys())
        long: dict[str, tuple[int, ...]] = {}
        if fresh:
            for w, ids in zip(fresh, self.words([w.encode("utf-8", "surrogatepass") for w in fresh])):
                (self.kept if len(w) <= KEPT_BYTES else long)[w] = ids
        get = (self.kept | long).__getitem__ if long else self.kept.__getitem__
        for words in cut:
            yield list(chain.from_iterable(map(get, words)))


@lru_cache(2)
def _encoder(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


def _vocabulary(df: DataFrame, path: str):
    """The file's bytes (under 2 MB, checked) for all workers."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 16_000_000:
        raise ValueError("the vocabulary is too large to be sent to every worker")
    return df.sparkSession.sparkContext.broadcast(data)


def _mapped(df: DataFrame, text: str, vocabulary: str, column: str, kind: str) -> DataFrame:
    shared = _vocabulary(df, vocabulary)
    spare = [c for c in df.columns if c not in (column, text)]
    out = df.select(*spare).withColumn(column, F.lit(None).cast(kind)).schema
    count = kind == "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for whole in batches:
            at, n = 0, whole.num_rows
            sizes = pc.fill_null(pc.binary_length(whole.column("__text")), 0).to_pylist()
            while at < n:  # at most about 8 MB of text at once, or one text
                end, room = at + 1, 8_000_000 - sizes[at]
                while end < n and room >= sizes[end]:
                    room -= sizes[end]
                    end += 1
                part = whole.slice(at, end - at)
                ids = encoder.batch(part.column("__text").to_pylist())
                if count:
                    new = pa.array(map(len, ids), pa.int32())
                else:
                    lists = list(ids)
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                    new = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in spare] + [new], [*spare, column])
                at = end

    return df.select(*spare, F.col(text).alias("__text")).mapInArrow(run, out)


def encode(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """df without text, with its ids (array of int) under the vocabulary; no special tokens.

    Null and empty texts give the empty array, repeated rows each come out, a text of any length is encoded whole; a
    column of df named like out is replaced. The scan is not shuffled: one pass, no order, nothing collected.
    """
    return _mapped(df, text, vocabulary, out, "array<int>")


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """df without text, with the number of its tokens; 0 for null and empty texts."""
    return _mapped(df, text, vocabulary, out, "int")
