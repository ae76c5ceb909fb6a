"""Importance resampling to a target distribution, with a dictionary of distinct features.

Features are runs of one and two words. They are counted as strings over the whole corpus and the target, each distinct string
is hashed once into a bucket, buckets are summed, and a bucket's gain (how much likelier it is in the target) goes back to the
counts of the documents.

1. Chunks of documents (the target's beside them) are written as a table: a chunk's words, most frequent first, and the
   documents as numbers of words. It stands for all counts of its documents at a quarter of the texts' size.
2. Each chunk counts its distinct features and sends them, packed, to tasks that own a range of hashes: a feature comes once from a
   chunk however often it occurs, so no feature is hot. There strings are counted in a dictionary, each is hashed once, the
   range's sums of buckets go to a sum over all ranges, and every chunk gets the bucket of each feature it sent, in its own order.
3. Gains of all buckets (DIMS numbers, whatever the corpus) reach every task; a chunk joins them with its documents' counts.

A task sends to at most 2^FAN others. Where more ranges are needed features are dealt in steps, packs of many chunks
being put together on the way and answers going back likewise, so what is sent is in proportion to the text at any size.

Drawing adds Gumbel noise, a function of seed and id, and takes the highest scores: documents are numbered in order by ranges, none is collected.

Defined results: a null text has no words; a null id is the text '' in the noise, and comes last in ties; repeated rows count each, and take ranks one after
another; without words the weight is 0; an empty target or corpus gives gains by the formula, an empty table an empty result; one text must fit a task; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import crc_sql, cut, documents, estimated_bytes, freed, id_type, release, sliced
from readloom.operators.cuts import numbered

#: Buckets of features, words from which on a document takes part, percentage that is drawn, and seed of the noise.
DIMS, LEAST_WORDS, DRAW, SEED = 10_000, 20, 25, 7
#: Bytes of text in a chunk and bytes of table for a range of features (these set how many there are of either); bits that one step deals.
CHUNK_BYTES, RANGE_BYTES, FAN = 28 << 20, 5 << 20, 13
_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))
_SCHEMA = "bucket long, lot long, payload binary"
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case."""
    return (text or "").encode().translate(_WORDS).split()


def pack(*values, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(values, 5))


def unpack(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def _small(x: np.ndarray) -> np.ndarray:
    """The integers in the smallest type that holds them."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    kinds = (np.uint8, np.uint16, np.uint32) if low >= 0 else (np.int8, np.int16, np.int32)
    return x.astype(next((k for k in kinds if np.iinfo(k).min <= low and high <= np.iinfo(k).max), np.int64))


def _steps(x: np.ndarray) -> np.ndarray:
    return _small(np.diff(x, prepend=np.int64(0)))


def _planes(x: np.ndarray) -> tuple[bytes, int]:
    """Integers as one plane for each byte: what packs well."""
    x = np.ascontiguousarray(_small(x))
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), x.itemsize


def _unplanes(b: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def squeezed(features: list[bytes]) -> bytes:
    """Features of one or two words, a line each; the first word is left out where it is that of the line before."""
    out, first = [], None
    for f in features:
        head, blank, tail = f.partition(b" ")
        out.append(blank + tail if blank and head == first else f)
        first = head
    return b"\n".join(out)


def spread(lines: bytes) -> list[bytes]:
    """The inverse of squeezed()."""
    out, first = [], b""
    for x in lines.split(b"\n"):
        if x[:1] == b" ":
            out.append(first + x)
        else:
            first = x.partition(b" ")[0]
            out.append(x)
    return out


class Route:
    """How features are dealt by hash: bits of each step, and in how many lots chunks are put together between steps."""

    def __init__(self, size: int):
        fan, bits = FAN, max(1, math.ceil(math.log2(max(1, size / RANGE_BYTES))))
        self.upto = [*range(fan, bits, fan), bits]
        lots, self.lots = max(1, size // CHUNK_BYTES), []
        for _ in self.upto[1:]:
            lots = max(1, lots >> fan)
            self.lots.append(lots)

    def lot(self, chunk, step: int):
        """The lot in which a chunk is after so many steps; after none its own."""
        for k in range(step):
            chunk = (chunk ^ (chunk >> 24)) % self.lots[k]
        return chunk

    def cut(self, hashes: np.ndarray, step: int) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.upto[step])).astype(np.int64)


def _rows(rows) -> pa.Table:
    rows = list(rows)
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "lot": pa.array([r[1] for r in rows], pa.int64()), "payload": pa.array([r[2] for r in rows], pa.binary())})


def _split(key: np.ndarray):
    """(value, positions) of each distinct value; positions keep their order."""
    order = np.argsort(key, kind="stable")
    return [(key[x[0]].item(), x) for x in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(x)]


class _Chunk:
    """Documents of one task that are counted together."""

    def __init__(self):
        self.ids, self.target, self.seq, self.words, self.bytes = [], [], [], {}, 0

    def add(self, target, doc_id, text):
        known = self.words
        self.seq.append(np.array([known.setdefault(w, len(known)) for w in words(text)], np.uint32))
        self.ids.append(doc_id)
        self.target.append(bool(target))
        self.bytes += len(text or "")

    def payload(self) -> bytes:
        names = list(self.words)
        seq = np.concatenate(self.seq) if self.seq else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(seq, minlength=len(names)), kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        return pack(self.ids, np.array(self.target, bool), b"\n".join(names[i] for i in order), _small(np.array([len(s) for s in self.seq], np.int64)), *_planes(rank[seq]))


class Counts:
    """A chunk's documents and its distinct features, in the order in which they are sent."""

    def __init__(self, payload: bytes, route: Route, places: bool = False):
        """places: with the place of each pair among the distinct ones, in place of their counts."""
        self.ids, self.target, names, lengths, seq, width = unpack(payload)
        self.names = names.split(b"\n") if names else []
        self.lengths, self.seq = lengths.astype(np.int64), _unplanes(seq, width).astype(np.int32)
        v = len(self.names)
        first = np.cumsum(self.lengths) - self.lengths
        starts = np.zeros(len(self.seq), bool)
        starts[first[self.lengths > 0]] = True
        #: A document's features: its words, and each word with the one before it.
        self.at = np.flatnonzero(~starts)
        if places:
            self.pairs, self.pair = np.unique(self._keys(self.at), return_inverse=True)
        else:
            self.pairs, self.n = np.unique(self._keys(self.at), return_counts=True)
        self.a, self.b = (self.pairs // max(v, 1)).astype(np.int32), (self.pairs % max(v, 1)).astype(np.int32)
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.names), np.uint64, v)
        both = h[self.a] * _FIRST ^ (h[self.b] * _SECOND >> np.uint64(7)) if v else np.zeros(0, np.uint64)
        h = np.concatenate([h, both])
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.hash = h ^ (h >> np.uint64(32))
        self.order = np.argsort(route.cut(self.hash, 0), kind="stable").astype(np.int32)

    def _keys(self, at: np.ndarray) -> np.ndarray:
        """The word at a place and the one before it as one number."""
        return self.seq[at - 1].astype(np.int64) * max(len(self.names), 1) + self.seq[at]

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each feature in the documents of either side, in the order of sending."""
        v = len(self.names)
        whole, aim = np.concatenate([np.bincount(self.seq, minlength=v), self.n]), np.zeros(len(self.hash), np.int64)
        if self.target.any():
            side = np.repeat(self.target, self.lengths)
            aim[:v] = np.bincount(self.seq[side], minlength=v)
            own, n = np.unique(self._keys(self.at[side[self.at]]), return_counts=True)
            aim[v + np.searchsorted(self.pairs, own)] = n
        return (whole - aim)[self.order], aim[self.order]

    def lines(self, of: np.ndarray) -> bytes:
        """squeezed() features by their numbers, without making the strings first."""
        v, names = len(self.names), self.names
        ones = of[of < v]
        two = of[of >= v] - v
        a, b = self.a[two], self.b[two]
        same = np.concatenate([[False], a[1:] == a[:-1]]) if len(a) else np.zeros(0, bool)
        out = [names[i] for i in ones.tolist()]
        out += [b" " + names[y] if s else names[x] + b" " + names[y] for x, y, s in zip(a.tolist(), b.tolist(), same.tolist(), strict=True)]
        return b"\n".join(out)

    def rows(self, chunk: int, route: Route):
        (raw, aim), bucket = self.sums(), route.cut(self.hash, 0)[self.order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
        more = len(route.upto) > 1
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            of = self.order[x:y]
            yield int(bucket[x]), route.lot(chunk, 1) if more else chunk, pack(chunk, x, _small(raw[x:y]), _small(aim[x:y]), self.lines(of), self.hash[of] if more else None, level=3)


def _items(payload: bytes):
    """chunk, number, raw, target, features, hashes of a pack: of one chunk (numbers follow one another) or of several."""
    chunk, number, raw, aim, lines, h = unpack(payload)
    features = spread(lines)
    if isinstance(chunk, int):
        return np.full(len(features), chunk, np.int64), np.arange(number, number + len(features)), raw.astype(np.int64), aim.astype(np.int64), features, h
    return np.cumsum(chunk, dtype=np.int64), np.cumsum(number, dtype=np.int64), raw.astype(np.int64), aim.astype(np.int64), features, h


def _deal(table: pa.Table, route: Route, step: int) -> pa.Table:
    """Packs of one bucket and lot of a step, dealt into the buckets of the next one."""
    parts = [_items(p) for p in table["payload"].to_pylist()]
    chunk, number, raw, aim, h = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2, 3, 5))
    features = [f for p in parts for f in p[4]]
    lot = (table["lot"][0].as_py() ^ (table["lot"][0].as_py() >> 24)) % route.lots[step + 1] if step + 1 < len(route.lots) else 0
    last = step + 2 == len(route.upto)

    def rows():
        for b, at in _split(route.cut(h, step + 1)):
            yield b, lot, pack(_steps(chunk[at]), _steps(number[at]), _small(raw[at]), _small(aim[at]), squeezed([features[i] for i in at.tolist()]), None if last else h[at])

    return _rows(rows())


def _dictionary(table: pa.Table):
    """Of one range: chunks, numbers, the features' places in the dictionary; the dictionary's strings, counts in corpus and target, and buckets."""
    parts = [_items(p) for p in table["payload"].to_pylist()]
    chunk, number, raw, aim = (np.concatenate([p[k] for p in parts]) for k in range(4))
    place: dict[bytes, int] = {}
    at = np.array([place.setdefault(f, len(place)) for p in parts for f in p[4]], np.int64)
    raw, aim = (np.bincount(at, x, len(place)).astype(np.int64) for x in (raw, aim))
    return chunk, number, at, list(place), raw, aim, np.fromiter((zlib.crc32(f) % DIMS for f in place), np.int64, len(place))


def _answers(bucket: int, chunk, number, said, route: Route, step: int):
    bucket >>= route.upto[step] - route.upto[max(step - 1, 0)]
    for lot, at in _split(route.lot(chunk, step)):
        yield bucket, lot, pack(_steps(chunk[at]), _steps(number[at]), said[at].astype(np.uint16))


def _count(table: pa.Table, route: Route) -> pa.Table:
    """One range: sums of its buckets (a row of bucket -1), and to each lot of chunks the buckets of their features."""
    chunk, number, at, _, raw, aim, hashed = _dictionary(table)
    sums = np.bincount(hashed, raw, DIMS).astype(np.int64), np.bincount(hashed, aim, DIMS).astype(np.int64)
    own = np.flatnonzero(sums[0] + sums[1])
    said = (-1, -1, pack(own.astype(np.uint16), *(_small(s[own]) for s in sums)))
    return _rows([said, *_answers(table["bucket"][0].as_py(), chunk, number, hashed[at], route, len(route.lots))])


def _return(table: pa.Table, route: Route, step: int) -> pa.Table:
    """Answers for one lot of a step, dealt out to the lots of the step before."""
    parts = [unpack(p) for p in table["payload"].to_pylist()]
    chunk, number, said = (np.concatenate([(np.cumsum(p[k], dtype=np.int64) if k < 2 else p[k]) for p in parts]) for k in range(3))
    return _rows(_answers(table["bucket"][0].as_py(), chunk, number, said, route, step - 1))


def _weigh(state: pa.Table, answers: pa.Table, gains: np.ndarray, route: Route, to: pa.Schema) -> pa.Table:
    """Each document of a chunk: n_words, and the sum of its features' gains."""
    own = Counts(state["payload"][0].as_py(), route, places=True)
    gain = np.zeros(len(own.hash), np.int64)
    for p in answers["payload"].to_pylist():
        _, number, said = unpack(p)
        gain[own.order[np.cumsum(number, dtype=np.int64)]] = gains[said.astype(np.int64)]
    per = gain[: len(own.names)][own.seq]
    per[own.at] += gain[len(own.names) :][own.pair]
    upto = np.concatenate([[0], np.cumsum(per)])
    stop = np.cumsum(own.lengths)
    total = upto[stop] - upto[stop - own.lengths]
    keep = np.flatnonzero(~own.target)
    cols = [[own.ids[i] for i in keep.tolist()], own.lengths[keep], total[keep]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, to, strict=True)], schema=to)


def _chunks(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The table of chunks: chunk, payload; written once."""
    from pyspark import TaskContext

    kind, limit = docs.schema["doc_id"].dataType, CHUNK_BYTES
    rows = docs.select(F.lit(False).alias("target"), "doc_id", F.col("text").cast("string").alias("text")).union(target.select(F.lit(True), F.lit(None).cast(kind), F.col("text").cast("string")))

    def row(part, n, chunk):
        return pa.RecordBatch.from_pydict({"chunk": [(part << 24) + n], "payload": [chunk.payload()]})

    def run(batches):
        part, n, chunk = TaskContext.get().partitionId(), 0, _Chunk()
        for batch in sliced(batches, 256):
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk.add(*x)
                if chunk.bytes >= limit:
                    yield row(part, n, chunk)
                    chunk, n = _Chunk(), n + 1
        if chunk.ids:
            yield row(part, n, chunk)

    return cut(rows.mapInArrow(freed(run), "chunk long, payload binary"))


def _sent(chunks: DataFrame, route: Route) -> DataFrame:
    """Packs of features, each in the range that owns it."""

    def send(batches):
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _rows(Counts(payload.as_py(), route).rows(chunk, route)).to_batches(max_chunksize=1000)

    rows = chunks.mapInArrow(freed(send), _SCHEMA)
    for step in range(len(route.upto) - 1):
        rows = rows.groupBy("bucket", "lot").applyInArrow(_spared(_deal, route, step), _SCHEMA)
    return rows


def _spared(f, *rest):
    def run(table):
        out = f(table, *rest)
        release()
        return out

    return run


def features(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The dictionary itself: feature, n (occurrences in docs), n_target, bucket of every distinct feature."""
    route = Route(estimated_bytes(docs))

    def run(table):
        *_, names, raw, aim, hashed = _dictionary(table)
        return pa.table({"feature": pa.array([f.decode() for f in names], pa.string()), "n": raw, "n_target": aim, "bucket": hashed})

    return _sent(_chunks(docs, target), route).groupBy("bucket").applyInArrow(run, "feature string, n long, n_target long, bucket long")


def gains_of(raw: list[int], aim: list[int]) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, one occurrence added to each."""
    s, t = float(sum(raw) + DIMS), float(sum(aim) + DIMS)
    return np.array([math.floor(1000 * math.log((float(a + 1) * s) / (float(r + 1) * t))) for r, a in zip(raw, aim, strict=True)], np.int64)


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean gain of its features) of each row of docs."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    route = Route(estimated_bytes(docs))
    chunks = _chunks(docs, target)
    found = cut(_sent(chunks, route).groupBy("bucket").applyInArrow(_spared(_count, route), _SCHEMA))

    def sums(batches):
        total = np.zeros((2, DIMS), np.int64)
        for batch in batches:
            for p in batch.column(0).to_pylist():
                own, raw, aim = unpack(p)
                total[:, own.astype(np.int64)] += raw, aim
        own = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_pydict({"bucket": own, "raw": total[0, own], "aim": total[1, own]})

    # DIMS rows at most, whatever the corpus
    said = found.where("bucket < 0").select("payload").mapInArrow(sums, "bucket long, raw long, aim long").groupBy("bucket").agg(F.sum("raw"), F.sum("aim")).collect()
    raw, aim = [0] * DIMS, [0] * DIMS
    for b, r, a in said:
        raw[b], aim[b] = r, a
    gains = docs.sparkSession.sparkContext.broadcast(gains_of(raw, aim))

    rows = found.where("bucket >= 0")
    for step in range(len(route.upto) - 1, 0, -1):
        rows = rows.groupBy("bucket", "lot").applyInArrow(_spared(_return, route, step), _SCHEMA)
    ddl = f"doc_id {id_type(docs)}, n_words long, total long"
    to = to_arrow_schema(StructType.fromDDL(ddl))

    def weigh(state, answers):
        out = _weigh(state, answers, gains.value, route, to)
        release()
        return out

    got = chunks.groupBy("chunk").cogroup(rows.groupBy("lot")).applyInArrow(weigh, ddl)
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(0)).alias("n_features")
    return got.select("doc_id", "n_words", n, F.when(F.col("n_words") > 0, F.expr("total div (2 * n_words - 1) - if(pmod(total, 2 * n_words - 1) <> 0 and total < 0, 1, 0)")).otherwise(0).cast("long").alias("weight"))


def noise(doc_id, seed: int = SEED) -> int:
    """Gumbel noise in thousandths: a function of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(rows: DataFrame, seed: int) -> DataFrame:
    """With score: the weight and the noise of the id."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            score = pa.array([w + noise(i, seed) for i, w in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, score], names=[*b.schema.names, "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, draw: int = DRAW, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs; rank: 1, 2, ... of the drawn documents, null of the others."""
    rows = cut(_scored(weights(docs, target), seed))
    takes_part = F.col("n_words") >= least_words
    n = rows.where(takes_part).count() * draw // 100
    placed = numbered(rows.where(takes_part), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place")
    out = ["doc_id", "n_features", "weight", "score"]
    rest = rows.where(~takes_part).select(*out, F.lit(None).cast("long").alias("rank"))
    return placed.select(*out, F.when(F.col("place") <= n, F.col("place")).alias("rank")).unionByName(rest)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, resampled towards all benchmark texts."""
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
with x as (select row_number() over () as id, doc_id, false as target, text from documents union all select -row_number() over (), null, true, text from benchmark),
w as (select id, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), '{_ALPHA}', '{_ALPHA.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from x),
f as (select id, target, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as feature from w),
c as (select id, target, feature, count(*) as n from f group by all),
d as (select feature, coalesce(sum(n) filter (not target), 0) as n, coalesce(sum(n) filter (target), 0) as t from c group by feature),
h as (select feature, n, t, {crc_sql("feature")} % {DIMS} as bucket from d),
b as (select bucket, sum(n) as s, sum(t) as t from h group by bucket),
g as (select bucket, floor(1000 * ln(((t + 1)::double * ((select sum(s) from b) + {DIMS})::double) / ((s + 1)::double * ((select sum(t) from b) + {DIMS})::double))) as gain from b),
m as (select c.id, sum(c.n) as n, sum(c.n * g.gain) as total from c join h using (feature) join g using (bucket) where not c.target group by c.id),
r as (select w.doc_id, len(w.w) as words, coalesce(m.n, 0)::bigint as n_features, coalesce(floor(m.total / m.n), 0)::bigint as weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(w.doc_id::varchar, '')), 1, 8))::bigint as h
  from w left join m on w.id = m.id where not w.target),
s as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from r)
select doc_id, n_features, weight, score,
  case when words >= {LEAST_WORDS} and place <= {DRAW} * (select count(*) from s where words >= {LEAST_WORDS}) // 100 then place end::bigint as rank
from (select *, row_number() over (partition by words >= {LEAST_WORDS} order by score desc, doc_id nulls last) as place from s)
"""
