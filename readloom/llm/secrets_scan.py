"""Secret scan: Aho-Corasick keyword prefilter, anchored regular expressions near hits, embedded checksums.

One pass of an automaton over the text (A-Z in lower case) finds every place where a secret can
begin; only there are the expressions tried, anchored. Tokens that carry a checksum are reported
only if it holds. Hexadecimal runs have no keyword; their class is its own prefilter.

Base kinds, spans in code points: assign (a keyword, a separator and a value of 6 or more
characters), access (AKIA and more, 20 or more characters), hex (24 or more digits). Added kinds:
github and npm (the last six characters are the CRC32 of the token's body in base 62), jwt (the
first part is a JSON object in base64url that names an algorithm).

Defined results: a null text is empty; repeated rows get equal rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import functools
import json
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import documents, freed, id_type, map_rows, sliced

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GITHUB = re.compile(r"gh[opsur]_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_NPM = re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
_RUN = re.compile(r"[A-Za-z0-9_-]*+")
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "npm_": "npm", "eyj": "jwt"} | {f"gh{x}_": "github" for x in "opsur"}
_RE = {"assign": _ASSIGN, "access": _ACCESS, "github": _GITHUB, "npm": _NPM, "jwt": _JWT}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_UPPER = {i: i + 32 for i in range(65, 91)}


def crc_base62(body: str, width: int = 6) -> str:
    """The CRC32 of body in base 62, padded with zeros."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(width):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out


def _holds(kind: str, m: re.Match) -> bool:
    """The kind's own test of a match: its length, or what it embeds."""
    if kind == "assign":
        return len(m[1]) >= 6
    if kind == "access":
        return m.end() - m.start() >= 20
    if kind in ("github", "npm"):
        return crc_base62(m[1][:-6]) == m[1][-6:]
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (binascii.Error, ValueError, RecursionError):  # not base64, not JSON, or nested beyond reason
        return False
    return isinstance(head, dict) and "alg" in head


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end), by start, then kind as listed. Per kind: leftmost, without overlap; a match that fails its test is dropped and not tried again from within."""
    text = text or ""
    low = text.lower() if text.isascii() else text.translate(_UPPER)
    done = dict.fromkeys(KINDS, 0)
    found = [("hex", *m.span()) for m in _HEX.finditer(text)]
    for last, (size, kind) in _automaton().iter(low):
        if (at := last + 1 - size) < done[kind]:
            continue
        if m := _RE[kind].match(text, at):
            done[kind] = m.end()
            if _holds(kind, m):
                found.append((kind, at, m.end()))
        elif kind == "jwt" and text.startswith("eyJ", at):
            # what follows this run of letters is not the rest of a token, so no start within the run can match: each run is read once
            done[kind] = _RUN.match(text, at).end()
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spelled(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end and the text found), for each row."""

    def run(ids, texts):
        return ids, [[{"kind": k, "start": a, "end": b, "found": (t or "")[a:b]} for k, a, b in scan(t)] for t in texts]

    return map_rows(docs, ["doc_id", F.col("text").cast("string")], f"doc_id {id_type(docs)}, spans array<struct<kind:string,start:int,end:int,found:string>>", run)


def mask(text: str | None, sign: str = "*") -> str | None:
    """The text with every secret written over; its length stays."""
    if text is None or not (spans := scan(text)):
        return text
    out, at = [], 0
    for _, a, b in spans:
        a = max(a, at)
        if b > a:
            out += [text[at:a], sign * (b - a)]
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, secrets in their texts written over."""
    import pyarrow as pa

    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in sliced(batches):
            texts = pa.array([mask(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(freed(run), docs.schema)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, and all spans."""
    docs = find(documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    say = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return docs.select("doc_id", *map(count, BASE_KINDS), F.sha2(say(base), 256).alias("base_sha256"), say(F.col("spans")).alias("spans"))
