"""Token ids as binary shards: a wavelet matrix in each file.

The ids of a shard are written as bit-planes, highest bit first; after a plane its ids are dealt, in order, into those
with a 0 and those with a 1, and the next plane is taken from that order. A plane is stored in blocks of BLOCK bits, each as it
is or compressed, whichever is less, and the file's last part holds where each block lies and how many ones are before it.
So from one compressed file, reading only the blocks that are needed: the id at a place (access), how often an id occurs before
a place (rank), where its k-th occurrence lies (select), and all ids in order.

Documents are put in order of doc_id by ranges, one task to a range; a task writes a file for each SHARD ids (a document is never
divided). Files are named by range and number, written aside and moved into place, so a task that runs again replaces its own.
A table of one row for each file tells the ids before it.

Encoding is that of the tokenizers library: its vocabulary lower-cases and drops white space, and no token or rule of it
crosses ASCII white space, so the library encodes a word's distinct pieces once and they are remembered (up to REMEMBER).

Defined results: a null text is empty and has the end id alone; null ids come first; rows of one id are in order of a hash of the text, then
of their place in the table; repeated rows each have their ids; an empty table writes no file and gives an empty result; a very long text is one document of one
file (its ids must fit a task, beside a file's); other columns are ignored.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import cut, documents, estimated_bytes, freed, id_type, shared_folder, sliced
from readloom.sources.ranges import opened

MAGIC = b"WMTX0001"
#: Bits of a plane in a block, ids in a file (or those of one longer document), and bytes of table for each range of documents.
BLOCK, SHARD, RANGE_BYTES = 1 << 16, 1 << 22, 32 << 20
#: Words, and pieces of words, whose ids a worker remembers (some 200 bytes each), and unpacked blocks that a reader keeps.
REMEMBER, KEEP_BLOCKS = 800_000, 64
END = 2


def _blocks(bits: np.ndarray):
    """(bytes, is compressed) of each block of a plane."""
    packed, size = np.packbits(bits, bitorder="little").tobytes(), BLOCK // 8
    c = zstandard.ZstdCompressor(level=1)
    for at in range(0, len(packed), size):
        raw = packed[at : at + size]
        small = c.compress(raw)
        yield (small, 1) if len(small) < len(raw) else (raw, 0)


def build(tokens: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray) -> bytes:
    """A file's bytes. tokens: the ids of all documents in order; lengths: how many each document has."""
    planes = max(1, int(tokens.max(initial=0)).bit_length())
    kind = np.uint16 if planes <= 16 else np.uint32
    a = np.ascontiguousarray(tokens, kind)
    out, at = [MAGIC], len(MAGIC)
    places, kinds, before, zeros = [], [], [], []
    for level in range(planes):
        bit = a & kind(1 << (planes - 1 - level)) != 0
        for data, packed in _blocks(bit):
            out.append(data)
            places.append(at)
            kinds.append(packed)
            at += len(data)
        ones = np.add.reduceat(bit, np.arange(0, len(bit), BLOCK), dtype=np.int64) if len(bit) else np.zeros(0, np.int64)
        before.append(np.cumsum(ones) - ones)
        zeros.append(len(bit) - int(ones.sum()))
        a = np.concatenate([a[~bit], a[bit]])
    sink = io.BytesIO()
    table = pa.table({"doc_id": doc_ids, "tokens": pa.array(lengths, pa.int64())})
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    parts = [np.array([*places, at], "<i8").tobytes(), bytes(kinds), np.concatenate(before).astype("<i8").tobytes(), np.array(zeros, "<i8").tobytes(), sink.getvalue()]
    foot = zstandard.ZstdCompressor(level=3).compress(struct.pack("<QI5I", len(tokens), planes, *map(len, parts)) + b"".join(parts))
    return b"".join([*out, foot, struct.pack("<I", len(foot)), MAGIC])


class Shard:
    """A file, read in parts. source: a seekable binary file."""

    def __init__(self, source):
        self.source, self.kept = source, OrderedDict()
        tail = len(MAGIC) + 4
        source.seek(0, 2)
        end = source.tell()
        size, magic = struct.unpack(f"<I{len(MAGIC)}s", self._read(end - tail, tail))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        foot = zstandard.ZstdDecompressor().decompress(self._read(end - tail - size, size))
        self.n, self.planes, *sizes = struct.unpack_from("<QI5I", foot)
        at, parts = struct.calcsize("<QI5I"), []
        for s in sizes:
            parts.append(foot[at : at + s])
            at += s
        self.per = -(-self.n // BLOCK)  # blocks of a plane
        self.places, self.kinds = np.frombuffer(parts[0], "<i8"), parts[1]
        self.before, self.zeros = np.frombuffer(parts[2], "<i8").reshape(self.planes, self.per), np.frombuffer(parts[3], "<i8")
        table = pa.ipc.open_stream(parts[4]).read_all()
        self.doc_ids, self.lengths = table["doc_id"].combine_chunks(), table["tokens"].to_numpy()

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _raw(self, level: int, block: int) -> bytes:
        i = level * self.per + block
        data = self._read(int(self.places[i]), int(self.places[i + 1] - self.places[i]))
        return zstandard.ZstdDecompressor().decompress(data) if self.kinds[i] else data

    def _sums(self, level: int, block: int) -> np.ndarray:
        """Ones of a block before each of its places, and after the last."""
        key = (level, block)
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        bits = np.unpackbits(np.frombuffer(self._raw(level, block), np.uint8), bitorder="little", count=min(BLOCK, self.n - block * BLOCK))
        sums = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        self.kept[key] = sums
        if len(self.kept) > KEEP_BLOCKS:
            self.kept.popitem(last=False)
        return sums

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before a place (the plane's end included)."""
        if at >= self.n:
            return self.n - int(self.zeros[level])
        block, i = divmod(at, BLOCK)
        return int(self.before[level, block] + self._sums(level, block)[i])

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        out = 0
        for level in range(self.planes):
            block, i = divmod(at, BLOCK)
            sums = self._sums(level, block)
            bit, ones = int(sums[i + 1] - sums[i]), int(self.before[level, block] + sums[i])
            out = out << 1 | bit
            at = int(self.zeros[level]) + ones if bit else at - ones
        return out

    def tokens(self, begin: int, stop: int) -> np.ndarray:
        """The ids of places begin to stop; all places go down the planes together, block by block."""
        at = np.arange(begin, stop, dtype=np.int64)
        out = np.zeros(len(at), np.uint32)
        for level in range(self.planes):
            bit, ones = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            block = at // BLOCK
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for here in np.split(order, cuts):
                if len(here):
                    b = int(block[here[0]])
                    sums, i = self._sums(level, b), at[here] - b * BLOCK
                    bit[here], ones[here] = sums[i + 1] - sums[i], self.before[level, b] + sums[i]
            out = out << np.uint32(1) | bit.astype(np.uint32)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, token: int, begin: int, stop: int) -> tuple[int, int]:
        """The places begin to stop of an id, after the last plane."""
        if token >> self.planes:
            return 0, 0
        for level in range(self.planes):
            a, b = self._ones(level, begin), self._ones(level, stop)
            if token >> (self.planes - 1 - level) & 1:
                begin, stop = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                begin, stop = begin - a, stop - b
        return begin, stop

    def count(self, token: int, begin: int = 0, stop: int | None = None) -> int:
        """How often an id occurs in places begin to stop."""
        a, b = self._range(token, begin, self.n if stop is None else min(stop, self.n))
        return b - a

    def rank(self, token: int, at: int) -> int:
        """How often an id occurs before a place."""
        return self.count(token, 0, at)

    def select(self, token: int, k: int) -> int:
        """The place of an id's k-th occurrence, from 0."""
        begin, stop = self._range(token, 0, self.n)
        if not 0 <= k < stop - begin:
            raise IndexError(k)
        at = begin + k
        for level in reversed(range(self.planes)):
            one = bool(token >> (self.planes - 1 - level) & 1)
            nth = at - int(self.zeros[level]) if one else at
            starts = np.arange(self.per) * BLOCK
            ahead = self.before[level] if one else starts - self.before[level]
            block = int(np.searchsorted(ahead, nth, "right")) - 1
            sums = self._sums(level, block)
            counts = sums if one else np.arange(len(sums)) - sums
            at = block * BLOCK + int(np.searchsorted(counts, nth - int(ahead[block]) + 1, "left")) - 1
        return at

    def occurrences(self, token: int):
        """All places of an id, in order."""
        return [self.select(token, k) for k in range(self.count(token))]

    def all(self) -> np.ndarray:
        """All ids: the planes' deals undone from the last to the first."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        v = np.zeros(self.n, kind)
        for level in reversed(range(self.planes)):
            raw = b"".join(self._raw(level, b) for b in range(self.per))
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=self.n).view(bool)
            out, z = np.empty_like(v), int(self.zeros[level])
            out[~bit] = v[:z]
            out[bit] = v[z:] | kind(1 << (self.planes - 1 - level))
            v = out
        return v


#: Words of ASCII and of Latin letters up to U+024F (all composed, all with plain lower-case forms but one): their pieces can be told before the library normalises.
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch
#: The vocabulary's own pieces, for such words in lower case: English endings, letters, single digits, other signs.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u024f]+").findall


def _letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printing bytes for themselves, the others in order from 256 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b if b in printing else 256 + others.index(b)) for b in range(256)}


_LETTERS = _letters()


class WordEncoder:
    """Ids of texts by a vocabulary of the tokenizers library, word by word. A word that is new is put together from its pieces where these can be told, so the library encodes each distinct piece, or else word, once."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.library, self.known, self.pieces = Tokenizer.from_str(vocabulary), {}, {}
        self.model = self.library.model
        self.kind = "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def _piece(self, p: str) -> bytes:
        """A piece's ids, by the library's model: it takes bytes as letters of its own."""
        out = self.pieces[p] = np.array([t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(_LETTERS))], self.kind).tobytes()
        return out

    def _learn(self, word: bytes) -> bytes:
        t = word.decode()
        if _PLAIN(t) and "<|" not in t:
            get = self.pieces.get
            out = b"".join([get(p) or self._piece(p) for p in _PIECES(t.lower())])
        else:
            out = np.array(self.library.encode(t, add_special_tokens=False).ids, self.kind).tobytes()
        self.known[word] = out
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        for memory in (self.known, self.pieces):
            if len(memory) > REMEMBER:
                memory.clear()
        get, learn, out = self.known.get, self._learn, []
        for t in texts:
            words = (t or "").encode().split()
            found = list(map(get, words))
            if not all(found):
                found = [f if f is not None else get(w) or learn(w) for f, w in zip(found, words, strict=True)]
            out.append(np.frombuffer(b"".join(found), self.kind))
        return out


_OPEN: dict[str, WordEncoder] = {}


def _encoder(shared) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    name, vocabulary = shared.value
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = WordEncoder(vocabulary)
    return _OPEN[name]


def store(path: str, data: bytes) -> None:
    """Write a file whole: aside first, then moved into place."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, inner = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    aside = f"{inner}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as f:
        f.write(data)
    system.move(aside, inner)


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END, shard: int = SHARD, storer=store) -> DataFrame:
    """Encode docs (doc_id, text) and write the files to a folder that all executors share. One row for each file: part, nth, path, docs, tokens, bytes. vocabulary: a path the driver can read."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_type

    import public_tokenizers

    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast((path, f.read()))
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        part, nth, ids, found, have = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            name = f"{folder}/{part:08d}-{nth:06d}.wm"
            data = build(np.concatenate(found), pa.array(ids, kind), np.array([len(x) for x in found], np.int64))
            storer(name, data)
            return pa.RecordBatch.from_pydict({"part": [part], "nth": [nth], "path": [name], "docs": [len(ids)], "tokens": [have], "bytes": [len(data)]})

        for batch in sliced(batches, 256):
            encoder = _encoder(shared)
            for i, x in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                if have and have + len(x) + 1 > shard:
                    yield flush()
                    nth, ids, found, have = nth + 1, [], [], 0
                ids.append(i)
                found.append(np.append(x, np.array([end], x.dtype)))
                have += len(x) + 1
        if ids:
            yield flush()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", F.xxhash64("text"), "row"]
    n = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-estimated_bytes(docs) // RANGE_BYTES))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return rows.mapInArrow(freed(run), "part long, nth long, path string, docs long, tokens long, bytes long")


def placed(files: DataFrame) -> DataFrame:
    """The table of files with `start`, the ids in all files before each: sums over one row for each range, then within a range."""
    per = files.groupBy("part").agg(F.sum("tokens").alias("all"))
    ahead = per.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    # each file is a task's work: so many partitions, which isn't left to the few bytes of this table
    n = max(1, files.count())
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    return files.join(F.broadcast(ahead), "part").withColumn("start", F.col("ahead") + within).drop("ahead").repartition(n, "part", "nth")


def read(files: DataFrame, doc_type: str = "long", opener=opened) -> DataFrame:
    """From the files alone: doc_id, start, n_tokens, ids (array<int>) of each document. files: path, start."""
    return _each(files, f"doc_id {doc_type}, start long, n_tokens long, ids array<int>", lambda ids: pa.array(list(ids), pa.list_(pa.int32())), opener)


def _crcs(ids) -> pa.Array:
    return pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())


def _each(files: DataFrame, ddl: str, last, opener) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    to = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opener(path) as f:
                    shard = Shard(f)
                    ids = shard.all().astype("<u4")
                stop = np.cumsum(shard.lengths)
                for at in range(0, len(stop), 512):
                    e, n = stop[at : at + 512], shard.lengths[at : at + 512]
                    cols = [shard.doc_ids.slice(at, 512), pa.array(start + e - n), pa.array(n), last([ids[x - y : x] for x, y in zip(e, n, strict=True)])]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, to, strict=True)], schema=to)

    return files.select("path", "start").mapInArrow(freed(run), ddl)


def find(files: DataFrame, token: int, opener=opened) -> DataFrame:
    """path, places: where an id occurs in each file, by rank and select; a place counts from the file's first id."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opener(path) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([Shard(f).occurrences(token)], pa.list_(pa.int64()))], names=["path", "places"])

    return files.select("path").mapInArrow(run, "path string, places array<long>")


def op12_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written to shards and read back from them."""
    docs = documents(spark, sf_dir)
    files = cut(write(docs, f"{shared_folder(spark)}/wavelet-{uuid.uuid4().hex}"))  # a row for each file: they are written once
    return _each(placed(files), f"doc_id {id_type(docs)}, start long, n_tokens long, ids_crc32 long", _crcs, opened)
