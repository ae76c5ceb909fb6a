"""Chat formatting, n-gram join, mixing, the pipeline, and queries against their SQL."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from readloom.llm import bpe, chat, mixing, ngram_join, quality_rules, queries, secrets_scan
from readloom.llm.components import components
from tests import oracle
from tests.llm.helpers import DOCS, EDGES, docs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert oracle.spark_rows(queries.QUERIES[name](spark, SF)) == oracle.duck_rows(oracle.duck(SF), queries.SQL[name])


TURNS = "conv_id long, turn long, role string, text string, example string"


def test_chat_expansion(spark):
    odd = "\\ <b> </turn> \\l \\\\s \\q \" ### Assistant:\n"
    rows = [
        (1, 0, "system", odd), (1, 1, "user", ""), (1, 2, "assistant", odd), (1, 3, "user", None), (1, 4, "assistant", "x"), (1, 5, "user", "tail"),
        (2, 0, "user", "alone"), (3, 0, 'odd"role<\\', "t"), (3, 1, None, None), (4, None, "assistant", "first"), (4, 0, "assistant", "b"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), (None, 0, "assistant", "n"),
    ]
    t = spark.createDataFrame([(*r, "clash") for r in rows], TURNS)
    e = chat.expand(t).where("conv_id = 1").orderBy("example").collect()
    assert [x.example for x in e] == [3, 5, 6] and e[-1].loss_start is None
    assert [x.formatted[x.loss_start : x.loss_end] for x in e[:2]] == ["\\s lb> l/turn> ".replace("lb", "\\lb").replace("l/", "\\l/") + "\\sl \\s\\ss \\sq \" ### Assistant:\n", "x"]
    assert e[1].formatted.startswith(e[0].formatted) and e[2].formatted.startswith(e[1].formatted)
    import hashlib

    got = {x.conv_id: x for x in chat.read_back(chat.expand(t)).collect()}
    by = defaultdict(list)
    for c, n, r, x in sorted(rows, key=lambda r: (r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        by[c].append((r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        said = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(said), sha(said))
    assert chat.read_back(chat.expand(spark.createDataFrame([], TURNS))).count() == 0


def brute_classes(rows):
    """Component ids by comparing all pairs that share a shingle."""
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted((str(r[0]), len(sets[k]), str(r[0] if not sets[k] else least.get(find(k)))) for k, r in enumerate(rows))


def families(seed: int, groups: int, size: int):
    """Texts edited by different amounts, and shared passages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    rows, n = [], 100
    for _ in range(groups):
        base = [word() for _ in range(r.randint(20, 120))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = word()
            rows.append((n, " ".join(w) if r.random() < 0.8 else " ".join(w[:10]) + " " + passage))
            n += 1
    return rows


SMALL = {"CHUNK_BYTES": 2000, "BUCKET_SHINGLES": 400, "BLOCK_SHINGLES": 250}


@pytest.mark.parametrize("sizes", [{}, SMALL, SMALL | {"BUCKET_SHINGLES": 0.3, "CHUNK_BYTES": 700, "FAN": 2}], ids=["as it is", "many chunks and blocks", "three steps"])
def test_ngram_join_equals_brute_force(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(ngram_join, k, v)
    rows = EDGES + families(1, 6, 14) + [(700, "tiny text"), (701, "TINY Text"), (702, "tiny  text")]
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in ngram_join.classes(docs(spark, rows)).collect())
    assert got == brute_classes(rows)


def test_ngram_exchange_keeps_whole_hashes_and_sends_in_proportion():
    """Packs of one chunk, dealt by routes of any size: all hashes come back whole, and few bytes more are sent where there are more buckets."""
    import pickle

    import numpy as np

    r = random.Random(4)
    c, memo, all_ = ngram_join._Chunk(), {}, {}
    for i in range(400):
        t = " ".join(str(r.randrange(3000)) for _ in range(r.choice([3, 40, 300])))
        c.add(i, t, memo)
        all_[i] = {int(x) for x in ngram_join.shingles(t, {})}
    sent = {}
    for size in (1, 10**9, 10**14, 10**18):
        route = ngram_join.Route(size)
        rows = list(c.rows(7, route))
        assert route.upto[0] in (ngram_join.HEAD, ngram_join.FAN) and len(rows) <= 2 ** ngram_join.FAN + 1
        sent[size] = sum(len(p) for _, _, p in rows)
        ids, sizes, sigs, own, owner, c2, d2 = pickle.loads(rows[-1][2])
        got: dict = {i: set() for i in range(400)}
        ends = np.concatenate([[0], np.cumsum(c2)])
        for b, _, p in rows[:-1]:
            for chunk, n, h, w in zip(*ngram_join._decode(p, route.first(b, 0)), strict=True):
                assert chunk == 7 and int(h) >> (ngram_join.HASH - route.upto[0]) == b
                docs_ = [n] if n < len(own) else d2[ends[n - len(own)] : ends[n - len(own) + 1]]
                assert w == len(docs_)
                for d in docs_:
                    got[own[d]].add(int(h))
        assert got == all_
    assert [len(ngram_join.Route(n).upto) for n in (1, 10**11, 10**14)] == [1, 2, 3] and sent[10**18] == sent[10**14] and sent[10**14] < 3 * sent[1]


def test_ngram_prefixes_never_lose_a_similar_pair():
    r = random.Random(2)
    import numpy as np

    for _ in range(300):
        n = r.randint(4, 60)
        a = set(r.sample(range(1000), n))
        b = set(r.sample(sorted(a), r.randint(int(n * 0.7), n))) | set(r.sample(range(1000, 2000), r.randint(0, n // 5)))
        df = {x: 2 + x % 7 for x in a | b}
        nodes = []
        for s in (a, b):
            shared = sorted(s & (a & b) | {x for x in s if x % 3 == 0}, key=lambda x: (df[x], x))
            nodes.append(ngram_join.Node(len(s), np.array(shared, "<u8").tobytes() + np.array([df[x] for x in shared], "<u2").tobytes()))
        if 100 * len(a & b) >= 75 * len(a | b):
            assert ngram_join.similar(*nodes)


def test_ngram_keep_one_and_empty(spark):
    rows = EDGES + families(3, 3, 6)
    clash = docs(spark, rows[-3:]).withColumnsRenamed({"n_chars": "h", "source": "__hash"})
    assert set(map(tuple, ngram_join.keep_one(clash).collect())) <= set(map(tuple, clash.collect()))
    d = docs(spark, rows).withColumnRenamed("n_chars", "sig")
    kept = ngram_join.keep_one(d)
    assert kept.columns == d.columns
    classes = {c for _, n, c in brute_classes(rows) if n}
    assert kept.where("doc_id >= 100").count() == len({c for i, n, c in brute_classes(rows) if n and i != "None" and int(i) >= 100})
    assert kept.where("trim(text) = '' or text is null").count() >= 3 and len(classes) > 3
    empty = spark.createDataFrame([], DOCS)
    assert ngram_join.classes(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5)]
    r = random.Random(4)
    r.shuffle(chain)
    got = {x.node: x.root for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_targets(sizes: dict):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, got = 1.5 * sum(sizes.values()), [s for s in names if sizes[s]], dict.fromkeys(names, 0.0)
    while open_ and left > 1e-9:
        share = left / sum(w[s] for s in open_)
        full = [s for s in open_ if got[s] + share * w[s] >= 2 * sizes[s]]
        for s in open_:
            add = min(share * w[s], 2 * sizes[s] - got[s])
            got[s] += add
            left -= add
        open_ = [s for s in open_ if s not in full]
    return got


def test_mixing_targets_and_sums(spark):
    r = random.Random(5)
    rows = [(i, "w " * r.randint(0, 30), "en", r.choice(["a", "a", "a", "a", "b", "c", "\u00e9", None, "Z"])) for i in range(800)] + [(9000, None, "en", "z"), (9001, "w", None, None)] + [(5, "dup dup", "en", "a")] * 3
    d = docs(spark, rows).withColumnRenamed("n_chars", "key")
    got = mixing.mix(d).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    of = {i: s for i, _, _, s in rows}
    assert len(got) == len(rows)
    for x in got:
        assert x.target == pytest.approx(want[of[x.doc_id]]) and 0 <= x.copies <= 2 and x.source_size == sizes[of[x.doc_id]]
    for s in sizes:
        took = sum(x.size * x.copies for x in got if of[x.doc_id] == s)
        assert abs(took - want[s]) <= 30
    again = {(x.doc_id, x.copies) for x in mixing.mix(d.repartition(5)).collect()}
    assert again == {(x.doc_id, x.copies) for x in got}
    taken = mixing.take(d)
    assert taken.columns == d.columns and taken.count() == sum(x.copies for x in got)
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0


def test_mixing_takes_part_of_repeated_rows(spark):
    d = docs(spark, [(1, "w " * 10, "en", "a")] * 2000 + [(i, "w " * 10, "en", "b") for i in range(2, 1002)]).repartition(7).cache()
    got = mixing.mix(d).collect()
    want = plain_targets({"a": 20_000, "b": 10_000})
    for ids, s in (({1}, "a"), (set(range(2, 1002)), "b")):
        assert abs(sum(x.size * x.copies for x in got if x.doc_id in ids) - want[s]) <= 5, s
    assert len(got) == 3000 and {x.copies for x in got if x.doc_id == 1} == {1, 2}
    assert mixing.take(d).count() == sum(x.copies for x in got)


def test_pipeline_equals_its_stages_in_plain_python(spark):
    import corpus_pipeline
    import public_tokenizers as p

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_copies", "secrets", "mixing", "byte_bpe"]
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in d.collect()]
    refs = {r.lang: r.ref for r in quality_rules.references(d).collect()}
    rows = [r for r in rows if quality_rules.judge(r[1], r[2], refs.get(r[2]))[6]]
    least = {(str(i)): c for i, _, c in brute_classes(rows)}
    rows = [r for r in rows if least[str(r[0])] == str(r[0])]
    rows = [(r[0], secrets_scan.mask(r[1]), *r[2:]) for r in rows]
    copies = {x.doc_id: x.copies for x in mixing.mix(spark.createDataFrame(rows, d.schema)).collect()}
    tok = bpe.Tokenizer(bpe.read_ranks(p.path("byte_bpe_50k.tiktoken")), p.PATTERN)
    want = sorted((r[0], len(tok.encode(r[1]))) for r in rows for _ in range(copies[r[0]]))
    assert sorted((x.doc_id, x.n_tokens) for x in corpus_pipeline.run(spark, SF).collect()) == want


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    out = spark.createDataFrame([], DOCS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = out.columns
        out = stage(spark, out, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == before
    assert out.count() == 0
