"""Hierarchical Pitman-Yor bigram model: a restaurant for each preceding word, all of them with the unigram restaurant as parent.

Customers of a context's restaurant are the words that follow it in the training documents; each
of its tables is a customer of the parent; the parent's base is uniform over the training words and
one unknown word. Table counts are sampled by Gibbs moves (a customer leaves, alone at its
table with the probability that the partition implies, and sits down again by the Chinese-restaurant
rule). A sweep moves every customer of every dish, those of a dish with more than GROUPS customers
in GROUPS groups that leave and return together; after BURN_IN sweeps the predictive probabilities, which are linear in the table counts, are
averaged over SAMPLES sweeps. Restaurants are seated given an estimate of the parent, the words'
frequencies in all training documents, then the parent given their tables (a blocked scan from the
leaves to the root).

Nothing of the corpus is held in one place. Chunks of documents send their distinct words, and then
their distinct word pairs, packed, to tasks that own a share of the words or contexts, and get
back numbers in the order they asked. No chunk or bucket sends to more than 2^FAN others: where there are more buckets rows are dealt in
several steps, those of many chunks being put together on the way and answers going back likewise, so what is sent is in proportion to the text at any size.
A frequent context is split by a hash of the following word; the
parts estimate the restaurant's tables from their share, and their sum is formed at the parent, by the bucket of the word that the context is made of.

Defined results: a null text is empty and has the end token alone; repeated rows are scored alike and
each counts in training; without training documents all words are unknown; an empty table gives an
empty result; other columns are ignored. A null id counts as the text '' in the crc32. A very long text is a chunk of its own and must fit a task; ties don't
arise, as nothing is ordered but numbers of words.
"""

from __future__ import annotations

import math
import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import documents, id_type

MOD, HELD_OUT = 7, 2
CHUNK_BYTES, BUCKET_TOKENS = 8 << 20, 1_200_000
#: Discounts and strengths of the contexts' restaurants and of the parent.
D, THETA, ROOT_D, ROOT_THETA = 0.85, 1.0, 0.7, 10.0
BURN_IN, SAMPLES = 4, 6
#: Into so many groups at most a sweep divides the customers of a dish; up to so many customers move one by one.
GROUPS = 16
#: Customers from which on a context is split, each part with about so many.
SPLIT = 200_000
#: Exact probabilities of sitting alone are tabulated up to so many customers of a dish; beyond, their limit d t / c is used.
TABLE = 128
_END = b"\n"  # no word holds a line end
_MEMO = 150_000


def pack(*values) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(values, 5))


def unpack(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def _planes(x: np.ndarray) -> tuple[bytes, int]:
    """Integers as one plane for each byte, as many as the largest needs: what packs well."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), width


def _unplanes(packed: tuple[bytes, int]) -> np.ndarray:
    b, width = packed
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel().astype(np.int64)


def _rise(x: np.ndarray) -> tuple[bytes, int]:
    """A sorted array by its differences."""
    return _planes(np.diff(x, prepend=x.dtype.type(0)))


def _unrise(packed: tuple[bytes, int]) -> np.ndarray:
    return np.cumsum(_unplanes(packed))


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % MOD == HELD_OUT


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), _END]


_ALONE: dict[float, np.ndarray] = {}


def alone_table(d: float) -> np.ndarray:
    """[c, t]: the probability that one of c customers at t tables of a Pitman-Yor partition sits alone, S(c-1, t-1) / S(c, t) with generalised Stirling numbers."""
    if d not in _ALONE:
        s = np.full((TABLE + 1, TABLE + 1), -np.inf)
        s[0, 0] = 0
        out = np.zeros((TABLE + 1, TABLE + 1))
        t = np.arange(TABLE + 1)
        for c in range(1, TABLE + 1):
            stay = np.maximum(c - 1 - d * t, 0)
            with np.errstate(divide="ignore"):
                s[c, 1:] = np.logaddexp(s[c - 1, :-1], s[c - 1, 1:] + np.log(stay[1:]))
            k = t[1 : c + 1]
            out[c, k] = np.exp(s[c - 1, k - 1] - s[c, k])
        out[2:, 1] = 0
        _ALONE[d] = out
    return _ALONE[d]


def _hits(m: np.ndarray, p: np.ndarray, rng) -> np.ndarray:
    """Of m trials each with probability p, how many succeed."""
    out = (rng.random(len(p)) < p).astype(np.int64)
    g = np.flatnonzero(m > 1)
    out[g] = rng.binomial(m[g], np.minimum(1, p[g]))
    return out


def _move(t: np.ndarray, m: np.ndarray, n: np.ndarray, p: np.ndarray, total: np.ndarray, d: float, theta: float, alone: np.ndarray, rng) -> np.ndarray:
    """The tables of dishes with n customers at t tables after m of each left and sat down again. total: the tables of their restaurants."""
    off = np.where(n <= TABLE, alone[np.minimum(n, TABLE), np.minimum(t, TABLE).astype(np.int64)], np.minimum(1, d * t / n))
    gone = np.minimum(_hits(m, np.where(t > 1, off, 0), rng), t - 1)
    rest = t - gone / m  # as the next of the m finds it
    new = (theta + d * (total - gone / m)) * p
    return t - gone + np.minimum(_hits(m, new / (new + n - 1 - d * rest), rng), n - t + gone)


def seat(c: np.ndarray, u: np.ndarray, base: np.ndarray, share: np.ndarray, d: float, theta: float, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table counts of dishes with c customers in restaurants u (0..): (mean over samples, last sample, mean tables of each restaurant here).

    base: the parent's probability of each dish. share: for each restaurant, how many times its tables all its parts have.
    """
    count, alone = len(share), alone_table(d)
    many = np.flatnonzero(c > 1)
    n, r, p = c[many], u[many], base[many]
    fixed = np.bincount(u[c == 1], minlength=count).astype(float)
    # first seating: customers come in growing groups, each group's new tables drawn at once
    t, seated = np.ones(len(n)), np.ones(len(n))
    total = (fixed + np.bincount(r, minlength=count)) * share
    while (left := seated < n).any():
        step = np.minimum(n - seated, np.maximum(1, np.floor(seated / 4)))
        new = (theta + d * total[r]) * p
        t += np.where(left, np.minimum(rng.poisson(step * new / (new + seated - d * t)), step), 0)
        seated += np.where(left, step, 0)
        total = (fixed + np.bincount(r, t, count)) * share
    mean, tables = np.zeros(len(n)), np.zeros(count)
    # a sweep: group by group, until every customer has moved once
    size = -(-n // GROUPS)
    turns = [(i, np.minimum(size[i], n[i] - k * size[i])) for k in range(GROUPS) if len(i := np.flatnonzero(k * size < n))]
    here = total / share
    for sweep in range(BURN_IN + SAMPLES):
        for i, m in turns:
            t[i] = _move(t[i], m, n[i], p[i], total[r[i]], d, theta, alone, rng)
            here = fixed + np.bincount(r, t, count)
            total = here * share
        if sweep >= BURN_IN:
            mean += t / SAMPLES
            tables += here / SAMPLES
    every = np.minimum(c, 1).astype(float)
    last = every.copy()
    every[many], last[many] = mean, t
    return every, last.astype(np.int64), tables


def parent_estimate(count: np.ndarray, n: int, v: int) -> np.ndarray:
    """The parent's probability of words with these counts among the n training tokens, v of them distinct."""
    return (count + ROOT_THETA / (v + 1)) / (n + ROOT_THETA)


def _mix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Kinds of rows: a chunk's documents, words, pairs, and what goes to or comes from the parent.
HOME, WORDS, PAIRS, PARENT = range(4)
#: Bits of a bucket's number by which one step of the exchange deals.
FAN = 12


def _rows(rows) -> pa.Table:
    kind, bucket, lot, payload = zip(*rows, strict=True) if (rows := list(rows)) else ((), (), (), ())
    return pa.table({"kind": pa.array(kind, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "lot": pa.array(lot, pa.int64()), "payload": pa.array(payload, pa.binary())})


class Route:
    """How rows reach their buckets: bits of a bucket's number after each step, and lots in which chunks are put together between steps.

    No task sends to more than 2^FAN others from one chunk, bucket or lot, at any number of buckets.
    """

    def __init__(self, bits: int, chunks: int):
        self.bits, self.buckets = bits, 1 << bits
        self.upto = [*range(FAN, bits, FAN), bits]
        self.lots = []
        for _ in self.upto[1:]:
            chunks = max(1, chunks >> FAN)
            self.lots.append(chunks)

    def lot(self, chunk, level: int, of: int = 0):
        """The lot of a chunk (or of a lot of another level); on level 0 the chunk itself."""
        for n in self.lots[of:level]:
            chunk = (chunk ^ (chunk >> 24)) % n
        return chunk

    @property
    def fan(self) -> int:
        return 1 << self.upto[0]

    def address(self, bucket, step: int):
        """Where rows for a bucket of the last step are sent in this one."""
        return bucket >> (self.bits - self.upto[step])

    def children(self, step: int) -> int:
        """Bits by which this step's buckets are divided in the next one."""
        return self.upto[step + 1] - self.upto[step]


def _by_hash(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def encode(members, counts, cols, forms: str, *extra) -> bytes:
    """Items of chunks (members, each with a count of items), column by column.

    Forms: a as it is, p planes of bytes, r runs of equal values, d rises within a chunk, o once for each distinct value of the column two before.
    """
    members, counts, out = np.asarray(members, np.int64), np.asarray(counts, np.int64), []
    for k, (x, form) in enumerate(zip(cols, forms, strict=True)):
        if form == "a":
            x = x.dtype.str, x.tobytes()
        elif form == "p":
            x = _planes(x)
        elif form == "r":
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
            x = _planes(x[at]), _planes(np.diff(at, append=len(x)))
        elif form == "d":
            first = (np.cumsum(counts) - counts)[counts > 0]
            d = np.diff(x, prepend=x.dtype.type(0))
            d[first] = x[first]
            x = _planes(d)
        elif form == "o":
            x = _planes(x[np.unique(cols[k - 2], return_index=True)[1]])
        out.append(x)
    return pack(_planes(members), _planes(counts), forms, out, extra)


def decode(b: bytes):
    """(members, counts, columns, forms, extra)."""
    members, counts, forms, packed, extra = unpack(b)
    members, counts, cols = _unplanes(members), _unplanes(counts), []
    for k, (x, form) in enumerate(zip(packed, forms, strict=True)):
        if form == "a":
            x = np.frombuffer(x[1], x[0])
        elif form == "p":
            x = _unplanes(x)
        elif form == "r":
            x = np.repeat(_unplanes(x[0]), _unplanes(x[1]))
        elif form == "d":
            d = _unplanes(x)
            c, few = np.cumsum(d), counts[counts > 0]
            first = np.cumsum(few) - few
            x = c - np.repeat(c[first] - d[first], few)
        elif form == "o":
            x = _unplanes(x)[np.unique(cols[k - 2], return_inverse=True)[1]]
        cols.append(x)
    return members, counts, cols, forms, extra


def _packs(table: pa.Table):
    """The decoded rows of a group, in an order that doesn't depend on how they came."""
    return sorted((decode(p) for p in table["payload"].to_pylist()), key=lambda x: int(x[0][0]))


def _columns(packs):
    return [np.concatenate(x) for x in zip(*(p[2] for p in packs), strict=True)]


def _deal(table: pa.Table, route: Route, step: int) -> pa.Table:
    """Rows of one bucket and lot of a step, put together and dealt into the buckets of the next one. A chunk's documents pass."""
    kind, bucket, lot = (table[c][0].as_py() for c in ("kind", "bucket", "lot"))
    if kind == HOME:
        return table
    fan, base = 1 << route.children(step), bucket << route.children(step)
    if lot < 0:
        return _new_rows(_joined_new(table), route, step + 1, range(base, base + fan), -1 - route.lot(-1 - lot, step + 2, step + 1))
    packs = _packs(table)
    cols, forms, extra = _columns(packs), packs[0][3], packs[0][4]
    members, counts = (np.concatenate([p[i] for p in packs]) for i in (0, 1))
    to = _by_hash(cols[0], route.bits) if kind == WORDS else _bucket(cols[0] >> PART_BITS, cols[0] & ((1 << PART_BITS) - 1), route.buckets) if kind == PAIRS else cols[1]
    owner, to = np.repeat(np.arange(len(members)), counts), route.address(to, step + 1) - base
    order = np.argsort(to, kind="stable")
    edge = np.searchsorted(to[order], np.arange(fan + 1))
    lot = route.lot(int(members[0]), step + 2)
    out = []
    for f in range(fan):
        at = order[edge[f] : edge[f + 1]]
        out.append((kind, base + f, lot, encode(members, np.bincount(owner[at], minlength=len(members)), [c[at] for c in cols], forms, *extra)))
    return _rows(out)


def _return(table: pa.Table, route: Route, step: int) -> pa.Table:
    """Answers of the buckets that a bucket of this step was divided into, for one lot: put together for each lot or chunk that had sent to it, what they say of all added up."""
    kind = table["kind"][0].as_py()
    if kind == HOME:
        return table
    came = sorted(zip(table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True))
    packs = [decode(p) for _, p in came]
    members, forms = packs[0][0], packs[0][3]
    cols, counts = _columns(packs), sum(p[1] for p in packs)
    extra = [sum(x) for x in zip(*(p[4] for p in packs), strict=True)]
    owner = np.concatenate([np.repeat(np.arange(len(members)), p[1]) for p in packs])
    order = np.argsort(owner, kind="stable")
    edge, to, out = np.concatenate([[0], np.cumsum(counts)]), route.lot(members, step), []
    for lot in np.unique(to):
        mine = np.flatnonzero(to == lot)
        at = np.concatenate([order[edge[m] : edge[m + 1]] for m in mine])
        out.append((kind, came[0][0] >> route.children(step), int(lot), encode(members[mine], counts[mine], [c[at] for c in cols], forms, *extra)))
    return _rows(out)


class _Chunk:
    def __init__(self):
        self.ids, self.lengths, self.seq, self.words, self.bytes = [], [], [], {}, 0

    def add(self, doc_id, text):
        words = self.words
        w = tokens(text)
        self.seq.append(np.array([words.setdefault(x, len(words)) for x in w], np.uint32))
        self.ids.append(doc_id)
        self.lengths.append(len(w))
        self.bytes += len(text or "")

    def rows(self, chunk: int, route: Route, memo: dict[bytes, int]):
        """Words with their training counts to each bucket of the first step; the documents themselves to a bucket of their own."""
        if len(memo) > _MEMO:
            memo.clear()
        h = np.empty(len(self.words), np.uint64)
        for w, i in self.words.items():
            x = memo.get(w)
            if x is None:
                x = memo[w] = xxhash.xxh3_64_intdigest(w)
            h[i] = x
        order = np.argsort(h)
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        seq = rank[np.concatenate(self.seq)]
        out = np.array([held_out(i) for i in self.ids])
        train = np.repeat(~out, self.lengths)
        count = np.bincount(seq[train], minlength=len(h))
        h = h[order]
        cuts = np.searchsorted(_by_hash(h, route.upto[0]), np.arange(route.fan + 1))
        lot = route.lot(chunk, 1)
        for b in range(route.fan):
            x = slice(cuts[b], cuts[b + 1])
            yield WORDS, b, lot, encode([chunk], [cuts[b + 1] - cuts[b]], [h[x], count[x]], "ap")
        yield HOME, chunk, chunk, pack(self.ids, out, np.array(self.lengths, np.int64), _planes(seq), int(rank[self.words[_END]]))


def _count_words(table: pa.Table, route: Route) -> pa.Table:
    """One bucket of words: to those who asked, numbers of their words and their training counts, in their order, and the bucket's totals."""
    if table["kind"][0].as_py() == HOME:
        return table
    bucket, packs = table["bucket"][0].as_py(), _packs(table)
    h, c = _columns(packs)
    known, inverse = np.unique(h, return_inverse=True)
    total = np.bincount(inverse, c, len(known)).astype(np.int64)
    out, at = [], 0
    for members, counts, (mine, _), *_ in packs:
        i = inverse[at : at + len(mine)]
        lot = route.lot(int(members[0]), len(route.lots))
        out.append((WORDS, bucket, lot, encode(members, counts, [i, total[i], np.full(len(i), bucket)], "dpr", int(total.sum()), int((total > 0).sum()))))
        at += len(mine)
    return _rows(out)


class _Home:
    """A chunk with what the words' buckets said."""

    def __init__(self, table: pa.Table, route: Route):
        said = []
        for kind, b, p in zip(*(table[c].to_pylist() for c in ("kind", "bucket", "payload")), strict=True):
            if kind == HOME:
                self.ids, self.out, self.lengths, seq, self.end = unpack(p)
            else:
                said.append((b, decode(p)))
        said = [x for _, x in sorted(said, key=lambda x: x[0])]
        self.seq = _unplanes(seq)
        #: Of each word the number within its bucket, the training count, and the bucket.
        self.index, self.count, self.bucket = _columns(said)
        self.n, self.v = sum(x[4][0] for x in said), sum(x[4][1] for x in said)
        #: Global word numbers: the number in the bucket, then the bucket.
        self.word = self.index * route.buckets + self.bucket
        self.start = len(self.word)  # the context before a text
        first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.before = np.concatenate([[self.start], self.seq[:-1]])
        self.before[first] = self.start
        # distinct pairs, by context, then word; the number of customers of each context is known from the word counts
        self.pairs, self.pair = np.unique(self.before * (self.start + 1) + self.seq, return_inverse=True)
        self.context, self.dish = self.pairs // (self.start + 1), self.pairs % (self.start + 1)
        self.customers = np.concatenate([self.count, [self.count[self.end]]])
        self.customers[self.end] = 0
        self.parts = np.maximum(1, -(-self.customers // SPLIT))
        self.name = np.concatenate([self.word + 1, [0]])  # of a context

    def layout(self, buckets: int):
        """The order in which pairs are sent: by bucket, context, part, word; in that order their parts and buckets."""
        part = (_mix(self.word[self.dish] + 1) % self.parts[self.context].astype(np.uint64)).astype(np.int64)
        to = _bucket(self.name[self.context], part, buckets)
        order = np.lexsort((self.dish, part, self.context, to))
        return order, part[order], to[order]


def _bucket(name: np.ndarray, part: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a part of a context."""
    return (_mix(_mix(name) + part.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


#: Bits of a part's number: parts of SPLIT customers for some 3e12 of one context; names have 39.
PART_BITS = 24


def part_key(name: np.ndarray, part: np.ndarray) -> np.ndarray:
    """One number for a part of a context; numbers that would run into the next context's are an error."""
    if len(part) and (int(part.max()) >> PART_BITS or int(name.max()) >> (63 - PART_BITS)):
        raise OverflowError("too many contexts, or parts of one")
    return (name << PART_BITS) + part


def _send_pairs(table: pa.Table, route: Route) -> pa.Table:
    """From one chunk: its pairs with training counts to the contexts' buckets, its words to the parent's."""
    home, chunk = _Home(table, route), table["lot"][0].as_py()
    train = np.repeat(~home.out, home.lengths)
    count = np.bincount(home.pair[train], minlength=len(home.pairs))
    order, part, to = home.layout(route.buckets)
    context, dish = home.context[order], home.dish[order]
    # pairs, with the parts of their contexts and how often their words occur in all training documents
    cols = [part_key(home.name[context], part), home.parts[context], home.word[dish], count[order], home.count[dish]]
    every = np.arange(route.fan + 1)
    edge, wedge = np.searchsorted(route.address(to, 0), every), np.searchsorted(route.address(home.bucket, 0), every)
    rows, lot = [], route.lot(chunk, 1)
    for i in range(route.fan):
        s, w = slice(edge[i], edge[i + 1]), slice(wedge[i], wedge[i + 1])
        rows.append((PAIRS, i, lot, encode([chunk], [edge[i + 1] - edge[i]], [c[s] for c in cols], "rrppo", home.n, home.v)))
        rows.append((PARENT, i, lot, encode([chunk], [wedge[i + 1] - wedge[i]], [home.index[w], home.bucket[w]], "dr", home.v)))
    return _rows(rows)


def _sums(key: np.ndarray, x: np.ndarray):
    known, i = np.unique(key, return_inverse=True)
    return known, np.bincount(i, x, len(known))


def _joined_new(table: pa.Table):
    """Words with new customers of the parent, and contexts with tables, of several rows."""
    word, new, name, tables = (np.concatenate(x) for x in zip(*([_unrise(a), _unplanes(b), _unrise(c), d] for a, b, c, d in map(unpack, table["payload"].to_pylist())), strict=True))
    word, new = _sums(word, new)
    return word, new.astype(np.int64), *_sums(name, tables)


def _new_rows(new, route: Route, step: int, buckets: range, lot: int) -> pa.Table:
    """These to the parent's buckets of a step: words to their own, tables of a context to that of the word it is made of (the context before a text has number -1 in the last)."""
    word, customers, name, tables = new
    to, owner = route.address(word % route.buckets, step), route.address((name - 1) % route.buckets, step)
    rows = []
    for b in buckets:
        w, u = to == b, owner == b
        rows.append((PARENT, b, lot, pack(_rise(word[w]), _planes(customers[w]), _rise(name[u]), tables[u])))
    return _rows(rows)


def _seat_contexts(table: pa.Table, route: Route) -> pa.Table:
    """One bucket of contexts: discounted counts of the pairs to those who asked; new customers, and tables of the contexts, to the parent. What is for the parent passes."""
    if table["kind"][0].as_py() != PAIRS:
        return table
    bucket, packs = table["bucket"][0].as_py(), _packs(table)
    keys, ways, w, c, seen = _columns(packs)
    known, u = np.unique(keys, return_inverse=True)
    share = np.ones(len(known))
    share[u] = ways
    words, dish = np.unique(w, return_inverse=True)
    # the parent as all training documents show it
    often, (n, v) = np.zeros(len(words), np.int64), packs[0][4]
    often[dish] = seen
    pairs, pair = np.unique(u * (len(words) + 1) + dish, return_inverse=True)
    total = np.bincount(pair, c, len(pairs)).astype(np.int64)
    pu, pw = pairs // (len(words) + 1), pairs % (len(words) + 1)
    base = parent_estimate(often, n, v)
    mean, last, tables = seat(total, pu, base[pw], share, D, THETA, np.random.default_rng(bucket))
    value = (total - D * mean).astype(np.float32)
    out, at = [], 0
    for members, counts, cols, *_ in packs:
        size = len(cols[0])
        out.append((PAIRS, bucket, route.lot(int(members[0]), len(route.lots)), encode(members, counts, [value[pair[at : at + size]]], "a")))
        at += size
    new = np.bincount(pw, last, len(words)).astype(np.int64)
    name, tables = _sums(known >> PART_BITS, tables)
    some, held = new > 0, tables > 0
    return pa.concat_tables([_rows(out), _new_rows((words[some], new[some], name[held], tables[held]), route, 0, range(route.fan), -1 - route.lot(bucket, 1))])


def _seat_parent(table: pa.Table, route: Route) -> pa.Table:
    """One bucket of the parent: customers less discounts of its words, and tables of their contexts, to those who asked, and its totals. Others' rows pass."""
    if table["kind"][0].as_py() != PARENT:
        return table
    bucket, buckets = table["bucket"][0].as_py(), route.buckets
    new = pc.less(table["lot"], 0)
    word, n, name, t = _joined_new(table.filter(new))
    packs = _packs(table.filter(pc.invert(new)))
    asked, _ = _columns(packs)
    size = 1 + int(max(asked.max(initial=-1), (word // buckets).max(initial=-1), ((name - 1) // buckets).max(initial=-1)))
    c = np.bincount(word // buckets, n, size).astype(np.int64)
    above = np.bincount((name - 1) // buckets + 1, t, size + 1)  # of the context before a text, then of the words
    # empty dishes have no tables; the other buckets hold as many tables of the one restaurant as this one
    v, share, rng = packs[0][4][0], np.array([float(buckets)]), np.random.default_rng(1_000_003 + bucket)
    mean, _, tables = seat(c, np.zeros(size, np.int64), np.full(size, 1 / (v + 1)), share, ROOT_D, ROOT_THETA, rng)
    value = (c - ROOT_D * mean).astype(np.float32)
    last, totals = len(route.lots), (float(c.sum()), float(tables[0]), float(above[0]))
    return _rows((PARENT, bucket, route.lot(int(m[0]), last), encode(m, k, [value[i], above[i + 1].astype(np.float32)], "aa", *totals)) for m, k, (i, _), *_ in packs)


def _probabilities(home: _Home, said_rows: pa.Table, route: Route) -> np.ndarray:
    """The averaged predictive probability of each distinct pair of a chunk."""
    said = sorted(zip(*(said_rows[c].to_pylist() for c in ("kind", "bucket", "payload")), strict=True), key=lambda x: x[:2])
    pairs, root = ([decode(p) for k, _, p in said if k == kind] for kind in (PAIRS, PARENT))
    value = np.empty(len(home.pairs))
    value[home.layout(route.buckets)[0]] = _columns(pairs)[0]
    words, tables = _columns(root)
    customers, root_tables, start = (sum(x) for x in zip(*(p[4] for p in root), strict=True))
    tables = np.append(tables.astype(float), start)
    parent = (words + (ROOT_THETA + ROOT_D * root_tables) / (home.v + 1)) / (ROOT_THETA + customers)
    n_u = home.customers[home.context]
    p = parent[home.dish]
    return np.where(n_u > 0, (value + (THETA + D * tables[home.context]) * p) / (THETA + n_u), p)


def _score(home_rows: pa.Table, said_rows: pa.Table, route: Route, to: pa.Schema) -> pa.Table:
    home = _Home(home_rows, route)
    logs = np.log10(_probabilities(home, said_rows, route))[home.pair]
    base = np.log10((home.count + 1) / (home.n + home.v + 1))[home.seq]
    first = np.cumsum(home.lengths) - home.lengths
    add = lambda x: np.add.reduceat(x, first)
    cols = [home.ids, home.out, home.lengths, add((home.count > 0)[home.seq].astype(np.int64)), np.full(len(home.ids), home.n), add(base), add(logs)]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(cols, to, strict=True)], schema=to)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0  # an estimate of the number of buckets only
    route = Route(max(0, math.ceil(math.log2(max(1, size / 7 / BUCKET_TOKENS)))), size // CHUNK_BYTES)

    def send(batches):
        part, n, chunk, memo = TaskContext.get().partitionId(), 0, _Chunk(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for i, t in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    chunk.add(i, t)
                    if chunk.bytes >= CHUNK_BYTES:
                        yield from _rows(chunk.rows((part << 24) + n, route, memo)).to_batches()
                        chunk, n = _Chunk(), n + 1
        if chunk.ids:
            yield from _rows(chunk.rows((part << 24) + n, route, memo)).to_batches()

    rows = "kind long, bucket long, lot long, payload binary"
    kind, bucket, lot = F.col("kind"), F.col("bucket"), F.col("lot")
    steps = range(len(route.lots))

    def done(df: DataFrame, f, *by) -> DataFrame:
        return df.groupBy(*by).applyInArrow(f, rows)

    def dealt(df: DataFrame, step: int) -> DataFrame:
        return done(df, lambda t: _deal(t, route, step), "kind", "bucket", "lot")

    def onward(df: DataFrame, step: int) -> DataFrame:  # what is new for the parent
        return done(df, lambda t: _deal(t, route, step) if t["lot"][0].as_py() < 0 else t, "kind", "bucket", "lot")

    def returned(df: DataFrame, step: int) -> DataFrame:
        return done(df, lambda t: _return(t, route, step), kind, F.shiftright(bucket, route.children(step)), lot)

    words = docs.mapInArrow(send, rows)
    for s in steps:
        words = dealt(words, s)
    words = done(words, lambda t: _count_words(t, route), "kind", "bucket")
    for s in reversed(steps):
        words = returned(words, s)
    pairs = done(words, lambda t: _send_pairs(t, route), "lot")
    for s in steps:
        pairs = dealt(pairs, s)
    said = done(pairs, lambda t: _seat_contexts(t, route), "kind", "bucket")
    for s in steps:
        said = onward(said, s)
    # answers of the contexts pass in groups of their own: those of a bucket for a lot, or, with one step, those for a chunk
    said = done(said, lambda t: _seat_parent(t, route), kind, bucket if steps else F.when(kind == PARENT, bucket), F.when(kind != PARENT, lot))
    for s in reversed(steps):
        said = returned(said, s)
    ddl = f"doc_id {id_type(docs)}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    to = to_arrow_schema(StructType.fromDDL(ddl))
    return words.groupBy("lot").cogroup(said.groupBy("lot")).applyInArrow(lambda a, b: _score(a, b, route, to), ddl)


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return scores(documents(spark, sf_dir))
