"""Byte-level BPE by two tiers: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

The rank file's strings are placed by a minimal perfect hash (buckets by one half of a 64-bit hash,
a seed for each bucket chosen so that its strings fall into free slots, largest buckets first). A
pre-token that is in the vocabulary is its own encoding; the lookup is one array read and one
comparison of bytes. Any other pre-token is a doubly linked list of bytes; a heap holds the ranks
of adjacent pairs, the lowest (then leftmost) is merged, stale heap entries are skipped: n log n for
any length. Encodings of pre-tokens are remembered in two tables of bounded size, of which the older goes when the newer is full.

Defined results: a null text encodes as an empty one; repeated rows get equal rows; an empty table
gives an empty result; other columns are ignored. Special tokens are never produced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from itertools import chain

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import documents, id_type, map_rows

#: Encodings of pre-tokens that a worker remembers, each of so many bytes at most.
REMEMBER, REMEMBER_BYTES = 250_000, 48
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Strings of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for s, r in pairs:
        out[int(r)] = base64.b64decode(s)
    return out


def _slot(h: int, seed: int, n: int) -> int:
    return (((h ^ (seed * 0x9E3779B97F4A7C15 & _MASK)) * 0xD6E8FEB86659FD93 & _MASK) >> 32) % n


class MinimalPerfectHash:
    """Maps n strings to 0..n-1 without gaps; a string that isn't among them is told by comparing it with the one in its slot."""

    PER_BUCKET = 3

    def __init__(self, strings: list[bytes]):
        self.n, self.buckets = len(strings), max(1, len(strings) // self.PER_BUCKET)
        hashes = [xxhash.xxh3_64_intdigest(s) for s in strings]
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            groups[(h & 0xFFFFFFFF) % self.buckets].append(i)
        self.seeds = [0] * self.buckets
        taken = bytearray(self.n)
        self.at = [0] * self.n
        singles = []
        for g in sorted(range(self.buckets), key=lambda g: -len(groups[g])):
            if len(groups[g]) < 2:
                singles += [(g, i) for i in groups[g]]
                continue
            for seed in range(1, 1 << 20):
                slots = [_slot(hashes[i], seed, self.n) for i in groups[g]]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
            else:
                raise ValueError("no seed places a bucket: two strings have one hash")
            self.seeds[g] = seed
            for i, s in zip(groups[g], slots, strict=True):
                taken[s], self.at[s] = 1, i
        free = (s for s in range(self.n) if not taken[s])
        for (g, i), s in zip(singles, free, strict=False):  # a bucket of one string names its slot directly
            self.seeds[g], self.at[s] = -1 - s, i
        self.strings = strings

    def get(self, s: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(s)
        seed = self.seeds[(h & 0xFFFFFFFF) % self.buckets]
        i = self.at[-1 - seed if seed < 0 else _slot(h, seed, self.n)]
        return i if self.strings[i] == s else None


class _Known(dict):
    """Encodings by pre-token; one that lacks is asked of the tokenizer, so a lookup that succeeds runs no Python."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, s: str) -> tuple[int, ...]:
        return self.tokenizer.piece(s)


class Tokenizer:
    """Encodes and decodes by the ranks of a vocabulary; each match of pattern separately."""

    def __init__(self, vocabulary: list[bytes], pattern: str, hashed: MinimalPerfectHash | None = None):
        self.vocabulary, self.hash = vocabulary, hashed or MinimalPerfectHash(vocabulary)
        self.ranks = {s: i for i, s in enumerate(vocabulary)}
        self.decimal = [str(i) for i in range(len(vocabulary))]
        self.findall = regex.compile(pattern).findall
        #: Ranks of all pairs of bytes.
        self.pairs = [[self.ranks.get(bytes((x, y))) for y in range(256)] for x in range(256)]
        #: What is remembered: encodings since the last turn, and those of the half before, from which what is met again comes back.
        self.known: dict[str, tuple[int, ...]] = _Known(self)
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, b: bytes) -> list[int]:
        """The encoding of a pre-token that isn't in the vocabulary."""
        n, rank, push, pop = len(b), self.ranks.get, heapq.heappush, heapq.heappop
        # end: where the part that begins at a place stops, which is where the next one begins; n, whose own end is 0, once it has been merged away. begin: where the part that stops at a place begins
        end, begin = [*range(1, n + 1), 0], list(range(-1, n))
        # rank, place and stop of a pair are one number, so the heap compares numbers instead of tuples
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = [(r << bits | i) << bits | i + 2 for i, (x, y) in enumerate(zip(b, b[1:], strict=False)) if (r := self.pairs[x][y]) is not None]
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            stop, i = x & mask, x >> bits & mask
            j = end[i]
            if end[j] != stop:  # one side has been merged meanwhile
                continue
            end[i], end[j], begin[stop] = stop, n, i
            if stop < n and (r := rank(b[i : (k := end[stop])])) is not None:
                push(heap, (r << bits | i) << bits | k)
            if i and (r := rank(b[(h := begin[i]) : stop])) is not None:
                push(heap, (r << bits | h) << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[b[i : end[i]]])
            i = end[i]
        return out

    def piece(self, s: str) -> tuple[int, ...]:
        b = s.encode()
        out = self.older.get(s)
        if out is None:
            i = self.hash.get(b)
            out = tuple(self.merge(b)) if i is None else (i,)
        if len(b) <= REMEMBER_BYTES:
            if len(self.known) >= REMEMBER // 2:
                self.older = dict(self.known)
                self.known.clear()
            self.known[s] = out
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_OPEN: dict[tuple[str, str], Tokenizer] = {}


def _tokenizer(shared) -> Tokenizer:
    """The worker's tokenizer of a broadcast vocabulary; the tables of the latest one stay, for the next task."""
    if shared.id not in _OPEN:
        _OPEN.clear()
        hashed, pattern = shared.value
        _OPEN[shared.id] = Tokenizer(hashed.strings, pattern, hashed)
    return _OPEN[shared.id]


@functools.lru_cache(maxsize=2)
def _hashed(path: str) -> MinimalPerfectHash:
    return MinimalPerfectHash(read_ranks(path))


class _Shared:
    """The hashed vocabulary and the pattern, built and broadcast by the driver, so the path need not exist on executors; its size is the vocabulary's."""

    def __init__(self, df: DataFrame, path: str | None, pattern: str | None):
        import public_tokenizers as p

        path = path or p.path("byte_bpe_50k.tiktoken")
        self.data = df.sparkSession.sparkContext.broadcast((_hashed(path), pattern or p.PATTERN))
        self.id = (path, pattern or p.PATTERN)

    @property
    def value(self):
        return self.data.value


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of ints): the encoding of each row's text."""
    voc = _Shared(docs, path, pattern)
    return map_rows(docs, ["doc_id", F.col("text").cast("string")], f"doc_id {id_type(docs)}, ids array<int>", lambda i, t: (i, [_tokenizer(voc).encode(x or "") for x in t]))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, bytes: the inverse of encode()."""
    voc = _Shared(rows, path, None)
    return map_rows(rows, ["doc_id", "ids"], f"doc_id {id_type(rows)}, bytes binary", lambda i, t: (i, [_tokenizer(voc).decode(x or []) for x in t]))


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded again in one pass, without moving the ids."""
    voc = _Shared(docs, path, pattern)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(ids, texts):
        tok = _tokenizer(voc)
        n, a, b = [], [], []
        for t in texts:
            x = tok.encode(t or "")
            n.append(len(x))
            a.append(sha(" ".join(map(tok.decimal.__getitem__, x)).encode()))
            b.append(sha(tok.decode(x)))
        return ids, n, a, b

    return map_rows(docs, ["doc_id", F.col("text").cast("string")], f"doc_id {id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string", run)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return digests(documents(spark, sf_dir))
