"""Jaccard self-join of documents on five-word shingles, with adaptive multi-match prefixes.

Exact, in these steps:

1. A document's set is its distinct shingles, as hashes of HASH bits. Chunks of documents send these, packed
   and dealt by hash range, to tasks that count in how many documents each occurs. No task sends to more than 2^FAN others: where more
   ranges are needed hashes are dealt in several steps, the packs of many chunks being put together on the way and
   answers going back likewise, so packs are in proportion to the text at any size. Equal sets (128-bit hashes of them) are
   one node; what a document has alone can be shared with nobody, so a node whose shared shingles
   are fewer than the similarity needs of its whole set is alone. Only the rest go on, with their shared shingles.
2. Shingles are put in one global order, rarest first. With t = 0.75, a set of n shingles overlaps
   a similar one in at least T = ceil(t n) of them, so the prefixes of n - T + l shingles of both share
   at least l (any l). Each node takes the l whose prefix has the least estimated cost: the
   postings it reads, plus the candidates it leaves to verify, which are at most postings / l. A pair is
   verified only if at least min(l1, l2) shingles of the two prefixes of that length agree.
3. Each shingle in a prefix has a hub, the node with the fewest shingles of its own among those that
   have it in theirs. Every node is compared with its hubs: rows in proportion to the prefixes, not
   pairs. Links make provisional groups.
4. Two nodes that share a prefix shingle share that shingle's hub. So for each hub, the nodes
   compared with it are dealt into blocks, and blocks are compared two by two, pairs of one group left
   out: all links between different groups are found, and within a group none is needed.
5. Groups are connected components, labelled with the least id.

Hashes of 56 bits stand for shingles throughout, at every size: six bytes are sent, the bucket tells the rest (whole 64 bits were
tried and take more disk than there is). Whether two sets are similar is wrong only if two different shingles of these very
sets share a hash, some 1.4 times in 10^11 pairs of sets of a thousand shingles; hashes shared elsewhere only add candidates.

Defined results: a text without words, or a null one, has an empty set and is linked with nothing;
fewer words than a shingle are one shingle; repeated rows are one node and get one label; a null
id takes part, and labels a group only if it has no other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import cut, documents, freed, id_type, release, sliced
from readloom.llm.components import components

SIZE, PERCENT = 5, 75
#: Bytes of text in a chunk, shingles in a bucket (these set how many there are of either), and shingles of the sets in a block of comparisons.
CHUNK_BYTES, BUCKET_SHINGLES, BLOCK_SHINGLES = 8 << 20, 2_500_000, 400_000
#: Bits of the hash by which one step deals, bits that a bucket's number always has, and bits of a hash.
FAN, HEAD = 11, 8
HASH = 48 + HEAD
#: Prefix extensions that are tried, and the cost of verifying a candidate in postings read.
MOST_MATCHES, VERIFY_COST = 12, 20
_MEMO = 150_000
#: Groups of so many bytes are followed by a release of memory.
RELEASE_BYTES = 1 << 20
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(SIZE)]


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted hashes (HASH bits) of the distinct shingles. memo: word hashes, bounded here."""
    words = (text or "").encode().lower().split()
    if len(memo) > _MEMO:
        memo.clear()
    hashes = []
    for w in words:
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    a = np.array(hashes, np.uint64)
    if not len(a):
        return a
    if len(a) < SIZE:
        return _finish(np.array([xxhash.xxh3_64_intdigest(a.tobytes())], np.uint64)) >> np.uint64(64 - HASH)
    n = len(a) - SIZE + 1
    s = a[:n] * _POWERS[0]
    for k in range(1, SIZE):
        s = s + a[k : n + k] * _POWERS[k]
    return np.unique(_finish(s) >> np.uint64(64 - HASH))


_TYPES = ("<u1", "<u2", "<u4", "<u8", "<i8")


def _least(x: np.ndarray) -> int:
    """The number of the smallest type that holds x."""
    top, low = (int(x.max()), int(x.min())) if len(x) else (0, 0)
    return 4 if low < 0 else next(k for k in range(4) if top < 1 << (8 << k))


def _encode(chunk: np.ndarray, number: np.ndarray, h: np.ndarray, weight: np.ndarray) -> bytes:
    """Items in order of chunk and number: six bytes of each hash as they are (the bucket tells the first bits), and the rest, which repeats itself, compressed: steps from item to item, and the weights after the leading ones."""
    low = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    n, ones = len(h), int(np.argmax(weight != 1)) if (weight != 1).any() else len(weight)
    one = (chunk[:1] == chunk).all()
    parts = [chunk[:1] if one else np.diff(chunk, prepend=np.int64(0)), np.diff(number, prepend=np.int64(0)), weight[ones:]]
    kinds = [_least(x) for x in parts]
    rest = zstandard.ZstdCompressor(level=1, write_checksum=False).compress(b"".join(x.astype(_TYPES[k]).tobytes() for x, k in zip(parts, kinds, strict=True)))
    return struct.pack("<II?BBB", n, ones, one, *kinds) + low + rest


def _decode(data: bytes, first: int):
    """chunk, number, h, weight; first: the first HEAD bits of the hashes."""
    n, ones, one, *kinds = struct.unpack_from("<II?BBB", data)
    h = np.zeros((n, 8), np.uint8)
    h[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 12).reshape(-1, 6)
    rest, at, parts = zstandard.ZstdDecompressor().decompress(data[12 + 6 * n :]), 0, []
    for size, k in zip((1 if one else n, n, n - ones), kinds, strict=True):
        x = np.frombuffer(rest, _TYPES[k], size, at)
        at += x.nbytes
        parts.append(x.astype(np.int64))
    chunk, number, weight = parts
    chunk = np.full(n, chunk[0], np.int64) if one else np.cumsum(chunk)
    return chunk, np.cumsum(number), h.view("<u8").ravel() | np.uint64(first << 48), np.concatenate([np.ones(ones, np.int64), weight])


class Route:
    """How hashes are dealt: bits of each step, and in how many lots chunks are put together between steps."""

    def __init__(self, size: int):
        bits = max(HEAD, math.ceil(math.log2(max(1, size / 7 / BUCKET_SHINGLES))))
        self.upto = [*range(max(HEAD, FAN), bits, FAN), bits]
        lots, self.lots = max(1, size // CHUNK_BYTES), []
        for _ in self.upto[1:]:
            lots = max(1, lots >> FAN)
            self.lots.append(lots)

    def next_lot(self, lot, step: int):
        """The lot of a lot (or of a chunk, step 0) in the next step; the last step has all in one."""
        return (lot ^ (lot >> 24)) % self.lots[step] if step < len(self.lots) else lot * 0

    def lot(self, chunk, step: int):
        """The lot in which a chunk is after so many steps; after none its own."""
        for k in range(step):
            chunk = self.next_lot(chunk, k)
        return chunk

    def first(self, bucket: int, step: int) -> int:
        return bucket >> (self.upto[step] - HEAD)


def _split(key: np.ndarray):
    """(value, positions) of each distinct value; positions keep their order."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    return [(key[x[0]].item(), x) for x in np.split(order, cuts) if len(x)]


def needed(n):
    """The least overlap of a set of n shingles with a similar one."""
    return -(-PERCENT * n // 100)


class _Chunk:
    """Documents of one task whose shingles are sent together."""

    def __init__(self):
        self.ids, self.sizes, self.sets, self.sigs, self.bytes = [], [], [], [], 0

    def add(self, doc_id, text, memo):
        s = shingles(text, memo)
        self.ids.append(doc_id)
        self.sizes.append(len(s))
        self.sigs.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
        self.sets.append(s)
        self.bytes += len(text or "")

    def rows(self, chunk: int, route: Route):
        """(bucket, lot, payload): one of shingles for each bucket of the first step, and one for the chunk itself, in a negative bucket.

        A shingle of one document has that document's number, one of several a number of its own above all documents'.
        """
        first: dict[bytes, int] = {}
        own = [i for i, s in enumerate(self.sigs) if s is not None and first.setdefault(s, i) == i]
        h = np.concatenate([self.sets[i] for i in own] or [np.zeros(0, np.uint64)])
        d = np.repeat(np.arange(len(own), dtype=np.int64), [self.sizes[i] for i in own])
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([start, [len(h)]])).astype(np.int64)
        several = count > 1
        number = np.where(several, len(own) - 1 + np.cumsum(several), d[start])
        c2, d2 = count[several], d[np.repeat(several, count)]
        h = h[start]
        bucket = (h >> np.uint64(HASH - route.upto[0])).astype(np.int64)
        order = np.lexsort((number, bucket))
        bucket, number, h, count = bucket[order], number[order], h[order], count[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
        lot = route.lot(chunk, 1) if route.lots else chunk
        mine = np.full(len(h), chunk, np.int64)
        for x, y in zip(edges[:-1], edges[1:]):
            yield int(bucket[x]), lot, _encode(mine[x:y], number[x:y], h[x:y], count[x:y])
        owner = [first.get(s, -1) if s is not None else -1 for s in self.sigs]
        yield -1 - chunk % (1 << route.upto[0]), chunk, pickle.dumps((self.ids, self.sizes, self.sigs, own, owner, c2.astype(np.uint32), d2.astype(np.uint32)))


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "lot": pa.array([r[1] for r in rows], pa.int64()), "payload": pa.array([r[2] for r in rows], pa.binary())})


def _items(table: pa.Table, route: Route, step: int):
    """All items of the rows of a bucket (or several) of a step, by chunk and number."""
    parts = [_decode(p, route.first(b, step)) for b, p in zip(table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True)]
    chunk, number, h, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((number, chunk))
    return chunk[order], number[order], h[order], weight[order]


def _spared(f, table: pa.Table, *rest):
    """f of a group; what a large one took goes back to the system."""
    out = f(table, *rest)
    if table.nbytes >= RELEASE_BYTES:
        release()
    return out


def _deal(table: pa.Table, route: Route, step: int) -> pa.Table:
    """Rows of one bucket and lot of a step, dealt into the buckets of the next one. Rows of chunks themselves pass."""
    if table["bucket"][0].as_py() < 0:
        return table
    items = _items(table, route, step)
    lot = route.next_lot(table["lot"][0].as_py(), step + 1)
    return _rows([(b, lot, _encode(*(x[at] for x in items))) for b, at in _split((items[2] >> np.uint64(HASH - route.upto[step + 1])).astype(np.int64))])


def _count(table: pa.Table, route: Route) -> pa.Table:
    """One bucket of the last step: the shingles that more than one document has, with the number of documents, by lot. Rows of chunks themselves pass."""
    if table["bucket"][0].as_py() < 0:
        return table
    chunk, number, h, weight = _items(table, route, len(route.upto) - 1)
    order = np.argsort(h, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
    total = np.add.reduceat(weight[order], start)
    df = np.empty(len(h), np.int64)
    df[order] = np.repeat(total, np.diff(np.concatenate([start, [len(h)]])))
    kept = df > 1
    items = chunk[kept], number[kept], h[kept], np.minimum(df[kept], 65535)  # larger counts only order alike
    return _answers(table["bucket"][0].as_py(), items, route, len(route.lots))


def _answers(bucket: int, items, route: Route, step: int) -> pa.Table:
    """Answers of one bucket of a step, by the lots of that step, for the bucket of the step before that it came from."""
    bucket >>= route.upto[step] - route.upto[max(step - 1, 0)]
    return _rows([(bucket, lot, _encode(*(x[at] for x in items))) for lot, at in _split(route.lot(items[0], step))] if len(items[0]) else [])


def _return(table: pa.Table, route: Route, step: int) -> pa.Table:
    """Answers for one lot of a step, dealt out to the lots of the step before. Rows of chunks themselves pass."""
    if table["bucket"][0].as_py() < 0:
        return table
    return _answers(table["bucket"][0].as_py(), _items(table, route, step - 1), route, step - 1)


def _gather(table: pa.Table, to: pa.Schema, route: Route) -> pa.Table:
    """One chunk: its documents, and for each set that may have a similar one its shared shingles, rarest first, with their counts."""
    mine = pc.less(table["bucket"], 0)
    ids, sizes, sigs, own, owner, c2, d2 = pickle.loads(table.filter(mine)["payload"][0].as_py())
    rest = table.filter(pc.invert(mine))
    _, number, h, f = _items(rest, route, 0) if rest.num_rows else (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
    alone = number < len(own)
    # all shingles that several documents of the chunk have come back, in the order of their numbers
    d = np.concatenate([number[alone], d2])
    h = np.concatenate([h[alone], np.repeat(h[~alone], c2)])
    f = np.concatenate([f[alone], np.repeat(f[~alone], c2)]).astype(np.uint16)
    order = np.lexsort((h, f, d))
    d, h, f = d[order], h[order], f[order]
    edge = np.searchsorted(d, np.arange(len(own) + 1))
    sets: list = [None] * len(ids)
    for k, i in enumerate(own):
        m = edge[k + 1] - edge[k]
        if m >= needed(sizes[i]):
            sets[i] = h[edge[k] : edge[k + 1]].tobytes() + f[edge[k] : edge[k + 1]].tobytes()
    return pa.Table.from_arrays([pa.array(ids, to.field(0).type), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], schema=to)


def shared_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), sig (of the set; null if empty), shared (packed shared shingles; null if nothing can be similar, or where the same set is in another row)."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # an estimate only: how many buckets there are
    route = Route(docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0)

    def send(batches):
        part, n, chunk, memo = TaskContext.get().partitionId(), 0, _Chunk(), {}
        for batch in sliced(batches, 256):
            for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk.add(i, t, memo)
                if chunk.bytes >= CHUNK_BYTES:
                    yield from _rows(list(chunk.rows((part << 24) + n, route))).to_batches()
                    chunk, n = _Chunk(), n + 1
        if chunk.ids:
            yield from _rows(list(chunk.rows((part << 24) + n, route))).to_batches()

    def each(f, *rest):
        return lambda t: _spared(f, t, *rest)

    schema = "bucket long, lot long, payload binary"
    rows = docs.mapInArrow(freed(send), schema)
    last = len(route.upto) - 1
    for step in range(last):
        rows = rows.groupBy("bucket", "lot").applyInArrow(each(_deal, route, step), schema)
    rows = rows.groupBy("bucket").applyInArrow(each(_count, route), schema)
    for step in range(last, 0, -1):
        rows = rows.groupBy("bucket", "lot").applyInArrow(each(_return, route, step), schema)
    ddl = f"doc_id {id_type(docs)}, n long, sig binary, shared binary"
    to = to_arrow_schema(StructType.fromDDL(ddl))
    return rows.groupBy("lot").applyInArrow(each(_gather, to, route), ddl)


class Node:
    """A set in the form that prefixes and comparisons need."""

    __slots__ = ("h", "full", "matches", "n", "prefix", "level", "sorted")

    def __init__(self, n: int, shared: bytes):
        m = len(shared) // 10
        self.n, self.h = n, np.frombuffer(shared, "<u8", m)
        f = np.frombuffer(shared, "<u2", m, 8 * m).astype(np.int64)
        alone, need = n - m, needed(n)
        reads = np.concatenate([[0], np.cumsum(f - 1)])
        best = None
        for ell in range(1, min(MOST_MATCHES, need) + 1):
            upto = min(max(n - need + ell - alone, 0), m)
            cost = reads[upto] * (1 + VERIFY_COST / ell)
            if best is None or cost < best[0]:
                best = (cost, ell, upto)
        _, self.matches, upto = best
        self.prefix = self.h[:upto]
        #: The least l whose prefix has the shingle.
        self.level = np.maximum(1, np.arange(upto) + 1 + alone - (n - need))
        self.sorted = None


def similar(a: Node, b: Node) -> bool:
    """Prefix test, then the exact similarity."""
    if 100 * min(a.n, b.n) < PERCENT * max(a.n, b.n):
        return False
    ell = min(a.matches, b.matches)
    if len(np.intersect1d(a.prefix[a.level <= ell], b.prefix[b.level <= ell], assume_unique=True)) < ell:
        return False
    both = len(np.intersect1d(a.h, b.h, assume_unique=True))
    return 100 * both >= PERCENT * (a.n + b.n - both)


def _compare_blocks(table: pa.Table, left: int, right: int):
    """Links between nodes of two blocks (or within one) that lie in different groups. Counts of common prefix shingles come from one sort of all prefixes; pairs with enough of them are verified."""
    keys, labels, sides = table["node"].to_pylist(), table["root"].to_pylist(), np.array(table["block"].to_pylist())
    nodes = [Node(n, s) for n, s in zip(table["n"].to_pylist(), table["shared"].to_pylist(), strict=True)]
    number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    group = np.array([number[x] for x in labels])
    h = np.concatenate([x.prefix for x in nodes])
    level = np.concatenate([x.level for x in nodes])
    who = np.repeat(np.arange(len(nodes)), [len(x.prefix) for x in nodes])
    ell = np.array([x.matches for x in nodes])
    size = np.array([x.n for x in nodes])
    order = np.argsort(h, kind="stable")
    h, level, who = h[order], level[order], who[order]
    out = []
    for i, x in enumerate(nodes):
        if left != right and sides[i] != left:
            continue
        a, b = np.searchsorted(h, x.prefix, "left"), np.searchsorted(h, x.prefix, "right")
        k = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
        y = who[k]
        most = np.minimum(ell[i], ell[y])
        ok = (level[k] <= most) & (np.repeat(x.level, b - a) <= most)
        hits = np.bincount(y[ok], minlength=len(nodes))
        near = (hits >= np.minimum(ell, ell[i])) & (group != group[i]) & (100 * np.minimum(size, x.n) >= PERCENT * np.maximum(size, x.n))
        near &= (np.arange(len(nodes)) > i) if left == right else (sides == right)
        for j in np.flatnonzero(near):
            z = nodes[j]
            both = len(np.intersect1d(x.h, z.h, assume_unique=True))
            if 100 * both >= PERCENT * (x.n + z.n - both):
                out.append((keys[i], keys[j]))
    return out


def _links_to_hubs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs (node, hub), the similar ones, as links a, b."""
    hubs = nodes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("shared").alias("hub_shared"))
    rows = pairs.where("near").select("node", "hub").join(nodes.select("node", "n", "shared"), "node").join(hubs, "hub")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cols = [c.to_pylist() for c in batch.slice(at, 256).columns]
                got, known = [], {}
                for x, y, n, s, m, t in zip(*cols, strict=True):
                    if y not in known:
                        known[y] = Node(m, t)
                    if similar(Node(n, s), known[y]):
                        got.append((x, y))
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["a", "b"])

    return rows.select("node", "hub", "n", "shared", "hub_n", "hub_shared").mapInArrow(freed(run), "a long, b long")


def _prefixes(nodes: DataFrame) -> DataFrame:
    """token, node, n, alone (the share of shingles that only this set has): the chosen prefixes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cols = [c.to_pylist() for c in batch.slice(at, 256).columns]
                got = [(k, Node(n, s)) for k, n, s in zip(*cols, strict=True)]
                lens = [len(x.prefix) for _, x in got]
                tok = np.concatenate([x.prefix for _, x in got] or [np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(tok), pa.array(np.repeat(np.array([k for k, _ in got], np.int64), lens)), pa.array(np.repeat(np.array([x.n for _, x in got], np.int64), lens)),
                    pa.array(np.repeat([1 - len(x.h) / x.n for _, x in got], lens), pa.float64()),
                ], names=["token", "node", "n", "alone"])

    return nodes.select("node", "n", "shared").mapInArrow(freed(run), "token long, node long, n long, alone double")


def _links_in_blocks(pairs: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between nodes of different groups that were compared with one hub."""
    own = pairs.join(roots, "node", "left").select("hub", "node", F.coalesce("root", "node").alias("root")).join(nodes.select("node", "n"), "node")
    groups = own.groupBy("hub", "root").agg(F.sum("n").alias("weight"), F.count("*").alias("members"))
    per_hub = groups.groupBy("hub").agg(F.count("*").alias("groups"), F.sum(F.when(F.col("weight") < BLOCK_SHINGLES, F.col("weight")).otherwise(0)).alias("small"))
    groups = groups.join(per_hub.where("groups > 1"), "hub")
    # a large group has blocks of its own; small groups share blocks
    large = F.col("weight") >= BLOCK_SHINGLES
    split = F.when(large, F.ceil(F.col("weight") / BLOCK_SHINGLES)).otherwise(1)
    shared = F.pmod(F.xxhash64("root"), F.ceil(F.greatest("small", F.lit(1)) / BLOCK_SHINGLES))
    groups = groups.select("hub", "root", split.cast("int").alias("split"), large.alias("large"), shared.alias("place"))
    rows = cut(
        own.join(groups, ["hub", "root"]).withColumn("block", F.when(F.col("large"), F.xxhash64("root", F.pmod(F.xxhash64("node"), F.col("split")))).otherwise(F.col("place"))).select("hub", "node", "root", "large", "block")
    )
    blocks = rows.groupBy("hub", "block").agg(F.first("large").alias("large"), F.min("root").alias("one"))
    other = blocks.select("hub", F.col("block").alias("right"), F.col("large").alias("large2"), F.col("one").alias("one2"))
    meet = blocks.withColumnRenamed("block", "left").join(other, "hub").where("left <= right and not (large and large2 and one = one2)").select("hub", "left", "right")
    sides = meet.select("hub", "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    work = sides.join(rows.select("hub", "block", "node", "root"), ["hub", "block"]).join(nodes.select("node", "n", "shared"), "node")

    def run(key, table):
        got = _spared(_compare_blocks, table, key[1].as_py(), key[2].as_py())
        return pa.table({"a": pa.array([g[0] for g in got], pa.int64()), "b": pa.array([g[1] for g in got], pa.int64())})

    return work.groupBy("hub", "left", "right").applyInArrow(run, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, for each row of docs. doc_id may be of any orderable type."""
    sets = cut(shared_sets(docs))
    # the checkpoint fixes the nodes' numbers
    nodes = sets.where("shared is not null").groupBy("sig").agg(F.first("n").alias("n"), F.first("shared").alias("shared"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    tokens = _prefixes(nodes)
    hubs = tokens.groupBy("token").agg(F.min(F.struct("alone", "node", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1")
    hubs = hubs.select("token", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    # near: the sizes alone don't rule out that the two are similar
    near = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * PERCENT
    pairs = cut(_prefixes(nodes).select("token", "node", "n").join(hubs, "token").where("node <> hub").select("node", "hub", near.alias("near")).distinct())
    links = cut(_links_to_hubs(pairs, nodes))
    more = cut(_links_in_blocks(pairs, nodes, components(links)))
    roots = components(links.union(more))
    # the least id: of equal sets, then of the component
    found = roots.join(nodes.select("node", "sig"), "node").select("sig", "root")
    known = sets.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least")).join(found, "sig", "left")
    alone = known.where("root is null").select("sig", F.col("least").alias("component_id"))
    joint = known.where("root is not null")
    least = joint.groupBy("root").agg(F.min("least").alias("component_id"))
    label = alone.union(joint.select("sig", "root").join(least, "root").select("sig", "component_id"))
    out = sets.select("doc_id", "n", "sig").join(label, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least id (then hash of the text), with all its columns; documents without words all stay."""
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", F.xxhash64(F.col("text").cast("string")).alias("h"))
    own = classes(keyed.select(F.struct("doc_id", "h").alias("doc_id"), F.col("doc.text").alias("text")))
    kept = own.where("n_shingles = 0 or doc_id = component_id").groupBy("doc_id").agg((F.max("n_shingles") > 0).alias("linked"), F.count("*").alias("times"))
    kept = cut(kept.select(F.col("doc_id.doc_id").alias("k_id"), F.col("doc_id.h").alias("k_hash"), (F.col("linked") & (F.col("times") > 1)).alias("repeated")))
    same = keyed["doc_id"].eqNullSafe(F.col("k_id")) & (keyed["h"] == F.col("k_hash"))
    single = keyed.join(kept.where("not repeated"), same, "left_semi")
    repeated = keyed.join(kept.where("repeated"), same, "left_semi").dropDuplicates(["doc_id", "h"])
    return single.unionByName(repeated).select("doc.*")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and classes of all documents."""
    return classes(documents(spark, sf_dir))


#: The same by joining on every shingle, and labels that spread along links; for small tables.
SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) as i from w where len(w) > 0) x),
n as (select w.doc_id, count(s.s) as n from w left join s on s.doc_id = w.doc_id group by w.doc_id),
l as (select a.doc_id as x, b.doc_id as y from s a join s b on a.s = b.s and a.doc_id < b.doc_id join n p on p.doc_id = a.doc_id join n q on q.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, p.n, q.n having 100 * count(*) >= 75 * (p.n + q.n - count(*))),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as d, doc_id as c from n union select e.y, r.c from r join e on e.x = r.d where r.c < e.y)
select n.doc_id, n.n as n_shingles, min(r.c) as component_id from n join r on r.d = n.doc_id group by n.doc_id, n.n
"""
