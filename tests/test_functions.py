"""Functions, specifications and formats by known answers and round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from readloom.functions import cigar, qual, seq
from readloom.operators import evidence, fastq, features, filters, lossy, pileup, projections, refs
from readloom.sources import bai, bam, cram, fasta, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def test_regions():
    r = filters.Region.parse("chr1:500-900")
    assert (r.name, r.start, r.end) == ("chr1", 500, 900) and str(r) == "chr1:500-900"
    assert filters.Region.parse("chr2").end == filters.OPEN_END and filters.Region.parse("chr2:7").start == 7
    for bad in ("", "a:b", "a:1-2-3"):
        with pytest.raises(ValueError):
            filters.Region.parse(bad)


@pytest.mark.parametrize("spec", ["SEQ", "*/*", "*", "SEQ:RNAME/*NM:AM", "*SEQ/NM", "/AM"])
def test_selector_prints_what_it_parses(spec):
    s = projections.Selector.parse(spec)
    assert projections.Selector.parse(str(s)) == s


def test_selector_meaning():
    s = projections.Selector.parse("*SEQ/*NM")
    assert not s.takes_field("SEQ") and s.takes_field("QNAME") and not s.takes_tag("NM") and s.takes_tag("AM")
    s = projections.Selector.parse("SEQ:AM")
    assert s.takes_field("SEQ") and s.takes_tag("AM") and not s.takes_tag("NM")
    with pytest.raises(ValueError):
        projections.Selector.parse("NOFIELD")


def test_policies():
    p = lossy.parse("m999_8")
    assert len(p) == 1 and p[0].read == ("m", 999) and p[0].treat == lossy.BIN and not p[0].bases
    p = lossy.parse("R8-N40")
    assert [(x.bases, x.treat) for x in p] == [([("R", 0)], lossy.BIN), ([("N", 0)], lossy.KEEP)]
    assert lossy.parse("N40-R8") == p  # keeping is applied last
    p = lossy.parse("R40X10-N40-U40")
    assert p[0].bases == [("R", 0), ("X", 10)] and p[2].read == ("U", 0)
    assert lossy.needs_pileup(p) and not lossy.needs_pileup(lossy.parse("N40-D8"))
    assert lossy.is_lossless(None) and lossy.is_lossless(lossy.parse("*40")) and not lossy.is_lossless([]) and not lossy.is_lossless(lossy.parse("*8"))
    assert str(lossy.parse("*8")[0]) == "bin scores of reads *"
    for bad in ("Q8", "R8!"):
        with pytest.raises(ValueError):
            lossy.parse(bad)


def test_sequences(spark):
    rng = random.Random(1)
    s = "".join(rng.choice("ACGTNacgt") for _ in range(51))
    assert one(spark, seq.reverse_complement(seq.reverse_complement(F.lit(s)))) == s
    assert one(spark, seq.normalize(F.lit("acgtnRx"))) == "ACGTNNN"
    assert one(spark, seq.is_valid(F.lit("ACGTn.-"))) and not one(spark, seq.is_valid(F.lit("ACGTQ")))
    assert one(spark, seq.from_nybbles(seq.nybbles(F.lit(s.upper())), F.lit(51))) == s.upper()
    with pytest.raises(Exception, match="not a base"):
        one(spark, seq.normalize_strict(F.lit("ACQ")))
    with pytest.raises(ValueError):
        seq.path_of("/a/%2s", F.lit("x"))
    assert one(spark, seq.path_of("/a/%2s/%3s/%s", F.lit("abcdefgh"))) == "/a/ab/cde/fgh"


def test_binning_is_idempotent_and_matches_single_scores(spark):
    every = "".join(chr(q + 33) for q in range(94))
    once = one(spark, qual.binned(F.lit(every)))
    assert one(spark, qual.binned(F.lit(once))) == once
    assert [ord(c) - 33 for c in once] == [qual.illumina_bin(q) for q in range(94)]
    assert set(ord(c) - 33 for c in once) == set(qual.ILLUMINA_VALUES)
    assert one(spark, qual.binned_score(F.lit(23))) == 22 and one(spark, qual.from_scores(F.array(F.lit(-1), F.lit(2)))) == "?#"


def test_cigars(spark):
    c = "5S10M2D3I1M4N2=1X3H"
    assert one(spark, cigar.render(cigar.parse(F.lit(c)))) == c and one(spark, cigar.render(cigar.parse(F.lit("*")))) == "*"
    assert one(spark, cigar.alignment_end(F.lit(10), F.lit(c))) == 9 + 10 + 2 + 1 + 4 + 2 + 1
    assert one(spark, cigar.render(cigar.merged(cigar.parse(F.lit("2M3M1I4M"))))) == "5M1I4M"
    assert one(spark, cigar.encode(cigar.parse(F.lit("3M2X")))) == [48, 40]
    assert evidence.pack([(3, "M"), (2, "M"), (2, "I"), (3, "D"), (4, "M")]) == "7M1D4M"
    # the longer keeps its kind; pad against deletion is a skip; in full agreement the later remains; the first two stay in place
    assert [evidence.pack(x) for x in ([(10, "M"), (2, "I"), (5, "D")], [(10, "M"), (5, "I"), (2, "D"), (4, "M")], [(10, "M"), (2, "P"), (5, "D"), (3, "M")], [(5, "I"), (2, "D"), (3, "M")], [(4, "M"), (3, "D"), (3, "I"), (2, "M")])] == [
        "12M3D", "10M2M3I4M", "10M3D2N3M", "3I5M", "4M5M",
    ]


def table(spark, rows):
    return spark.createDataFrame([(i, f"q{i}", 0, "r", p, s, "I" * len(s), c) for i, (p, s, c) in enumerate(rows)], "rec_idx long, qname string, flag int, rname string, pos int, seq string, qual string, cigar string").withColumn("aln_end", cigar.alignment_end(F.col("pos"), F.col("cigar")))


def test_md_and_nm(spark):
    ref = spark.createDataFrame([("r", "ACGT")], "rname string, seq string")
    rows = [(1, "ACGT", "4M"), (1, "CCGT", "4M"), (2, "CGT", "3M"), (2, "AGT", "3M"), (2, "AGC", "3M"), (1, "AT", "1M2D1M"), (1, "ATTC", "1M2I1M"), (3, "GTAA", "4M"), (1, "TTAC", "2S2M")]
    got = {x.rec_idx: (x.md, x.nm) for x in pileup.md_nm(table(spark, rows), ref).collect()}
    assert [got[i] for i in range(9)] == [("4", 0), ("0A3", 1), ("3", 0), ("0C2", 1), ("0C1T0", 2), ("1^CG1", 2), ("2", 2), ("2", 0), ("2", 0)]


def test_features_rebuild_bases_and_cigars(spark):
    rng = random.Random(2)
    contig = "".join(rng.choice("ACGT") for _ in range(300))
    ref = spark.createDataFrame([("r", contig)], "rname string, seq string")
    rows = []
    for c in ("20M", "3S10M2D5M", "5M3I4M1I2M", "4M10N6M", "2S3M1I3M2D4M2S", "5M1D1I5M"):
        p = rng.randint(1, 200)
        s, at = "", p
        import re

        for n, o in re.findall(r"(\d+)([MSIDN])", c):
            n = int(n)
            if o == "M":
                s += "".join(b if rng.random() < 0.8 else rng.choice("ACGT") for b in contig[at - 1 : at - 1 + n])
            if o in "SI":
                s += "".join(rng.choice("ACGT") for _ in range(n))
            at += n * (o in "MDN")
        rows.append((p, s, c))
    r = table(spark, rows)
    f = features.read_features(r, ref)
    assert {x.rec_idx: x.seq for x in features.restore_bases(r, f, ref).collect()} == {i: x[1] for i, x in enumerate(rows)}
    arrays = features.feature_arrays(f)
    none = F.array().cast("array<struct<pos:int,idx:int,op:string,len:int,bases:string>>")
    got = r.join(arrays, "rec_idx", "left").select("rec_idx", features.cigar_of(F.coalesce("features", none), F.length("seq")).alias("c")).collect()
    assert {x.rec_idx: x.c for x in got} == {i: x[2] for i, x in enumerate(rows)}


def test_coverage_is_what_elements_consume(spark):
    r = table(spark, [(1, "A" * 6, "2M3D4M"), (3, "AC", "2M"), (9, "A", "1M"), (5, "A" * 4, "1S3M")])
    got = {x.ref_pos: x.coverage for x in pileup.coverage(r, tile=4).collect()}
    want = {}
    for a, b in ((1, 9), (3, 4), (9, 9), (5, 7)):
        for p in range(a, b + 1):
            want[p] = want.get(p, 0) + 1
    assert got == want


def test_reference_regions(spark):
    ref = spark.createDataFrame([(0, "chr1", "ACGT")], "ref_id int, rname string, seq string")
    get = lambda a, b: refs.region(ref, "chr1", a, b).collect()[0].seq
    assert (get(1, 5), get(4, 6), get(5, 10), get(2, 3)) == ("ACGT", "T", "", "CG")
    with pytest.raises(Exception, match="outside of"):
        refs.strict_region(ref, "chr1", 1, 5).collect()


def test_overlap_resolution():
    assert evidence.resolve("4M2B4M", "ACGTCTAA", "IIII!JII") == ("6M", "ACGTAA", "IIIJII", "2S2G2S", "GTCT", "II!J")
    assert evidence.resolve("6M", "ACGTAA", "IIIIII")[:4] == ("6M", "ACGTAA", "IIIIII", "6S")
    assert evidence.resolve("4M2B4M", "AAAACCCC", "IIIIIIII")[:2] == ("6M", "AACCCC")
    assert evidence.resolve("4M4B1M2P3D3M1N2M", "ABCDEFGHIJ", "I" * 10) == ("4M1N2M", "EFGHIJ", "I" * 6, "0S4G2S", "ABCDEFGH", "I" * 8)
    with pytest.raises(ValueError):
        evidence.resolve("2M3B4M", "ACGTAA", "IIIIII")


def reads(spark):
    from readloom.plans import fixtures

    return fixtures.reads(spark, "/root/testdata/sf0.001").where("rec_idx < 300")


FIELDS = "qname flag rname pos mapq cigar seq qual".split()


def test_sam_text_round_trip(spark, tmp_path):
    r = reads(spark)
    text.write_sam(r, str(tmp_path / "a"), ["@HD\tVN:1.0\tSO:unsorted", "@SQ\tSN:chr1\tLN:2000", "@RG\tID:rg1", "@CO\tsome words"])
    got = text.read_sam(spark, str(tmp_path / "a"))
    rows = lambda d: sorted(tuple(map(str, x)) for x in d.select(*FIELDS, F.array_sort(F.map_entries("tags")).cast("string")).collect())
    assert rows(got.select(*FIELDS, "tags")) == rows(r)
    h = {(x.kind, x.name) for x in text.read_sam_header(spark, str(tmp_path / "a")).collect()}
    assert h == {("HD", None), ("SQ", "chr1"), ("RG", "rg1"), ("CO", None)}
    assert text.dense_numbers(text.numbered_lines(spark, str(tmp_path / "a"))).agg(F.max("rec_idx")).collect()[0][0] == 303


def test_bam_round_trip(spark, tmp_path):
    r = reads(spark).withColumns({"rnext": F.lit("*"), "pnext": F.lit(0), "tlen": F.lit(0)})
    r = r.withColumn("tags", F.expr("map_concat(map_filter(tags, (k, v) -> k <> 'XA'), map('XB', struct('B' as type, 's,1,-2,3' as value), 'XF', struct('f' as type, '0.5' as value), 'XC', struct('A' as type, 'q' as value)))"))
    for x in bam.to_bam(r, [(f"chr{i}", 2000) for i in range(1, 6)], "@CO\tx\n", 2).collect():
        (tmp_path / f"{x.part}.bam").write_bytes(bytes(x.content))
    got = bam.read_bam(spark, f"{tmp_path}/*.bam")
    rows = lambda d: sorted(tuple(map(str, x)) for x in d.select(*FIELDS, F.array_sort(F.map_entries("tags")).cast("string")).collect())
    assert rows(got) == rows(r)
    assert {x.format for x in text.detect_format(spark, f"{tmp_path}/*.bam").collect()} == {"BAM"}
    assert all(x.complete for x in text.is_complete(spark, f"{tmp_path}/*.bam").collect())


def test_fastq_and_fasta_files(spark, tmp_path):
    from readloom.operators import fastq

    f = fastq.fastq_records(reads(spark))
    text.write_fastq(f, str(tmp_path / "fq"))
    got = text.read_fastq(spark, str(tmp_path / "fq" / "segment=1"))
    want = f.where("segment = 1").select("seq", "qual")
    assert sorted(map(tuple, got.select("seq", "qual").collect())) == sorted(map(tuple, want.collect()))
    (tmp_path / "x.fa").write_text(">chr1 first one\nACG\nTac\n>chr2\nGG\n")
    assert [(x.rname, x.seq) for x in text.read_fasta(spark, str(tmp_path / "x.fa")).collect()] == [("chr1", "ACGTAC"), ("chr2", "GG")]
    assert text.read_fasta_folder(spark, str(tmp_path)).count() == 2


def test_index_mask_and_evidence_files(spark, tmp_path):
    from readloom.operators import index

    i = index.slice_index(reads(spark))
    text.write_crai(i, str(tmp_path / "crai"))
    assert sorted(map(tuple, text.read_crai(spark, str(tmp_path / "crai")).collect())) == sorted(tuple(x) for x in i.select("seq_id", "start", "span", "container_offset", "slice_offset", "size").collect())
    (tmp_path / "bad.crai").write_text("1\t2\t3\n")
    with pytest.raises(Exception, match="not an index line"):
        text.read_crai(spark, str(tmp_path / "bad.crai")).collect()
    (tmp_path / "m").write_text("3 1 2\n__x_x\n\nhello\n")
    assert [(x.kind, x.mask) for x in text.read_masks(spark, str(tmp_path / "m")).orderBy("rec_idx").collect()] == [("integers", [1, 2, 3]), ("letters", [3, 5]), ("integers", []), ("unknown", None)]
    (tmp_path / "e").write_text("#TYPE\tEVIDENCE\n\n>" + "\t".join(evidence.COLUMNS) + "\n" + "\t".join(str(k) for k in range(21)) + "\n")
    assert text.read_evidence(spark, str(tmp_path / "e")).collect()[0].Chromosome == "1"
    assert text.evidence_header(spark, str(tmp_path / "e")).collect()[0].key == "TYPE"


def test_encryption_and_candidates(spark):
    d = spark.createDataFrame([("secret",)], "v string")
    key = "0123456789abcdef"
    sealed = text.encrypted(d, "v", key)
    assert sealed.collect()[0].v != "secret" and text.decrypted(sealed, "v", key).collect()[0].v == "secret"
    assert "a.crai" in text.index_candidates("a.cram") and "a.bam.BAI" in text.index_candidates("a.bam")


def test_merge_of_a_split_is_the_whole_and_a_file_does_not_differ_from_itself(spark):
    from readloom.operators import diff, merge

    r = reads(spark)
    m = merge.merged({"a": r.where("rec_idx % 2 = 0"), "b": r.where("rec_idx % 2 = 1")})
    assert m.count() == r.count() and m.withColumn("qname", F.expr("substring(qname, 3, 100)")).select(*FIELDS).exceptAll(r.select(*FIELDS)).isEmpty()
    assert diff.rows(r, r).isEmpty() and diff.tags(r, r).isEmpty()


def test_container_batches(spark):
    from readloom.operators import index

    lengths = [("a", 500), ("b", 400), ("c", 2500), ("*", 10)]
    names = [n for n, k in lengths for _ in range(k)]
    r = spark.createDataFrame(list(enumerate(names)), "rec_idx long, rname string")
    got = [tuple(x) for x in index.containers(r, size=1000, least=800).orderBy("container").collect()]
    assert got == [(0, 0, 900), (1, 900, 1000), (2, 1900, 1000), (3, 2900, 500), (4, 3400, 10)]
    got = [tuple(x) for x in index.containers(r, sorted_input=False, size=1000).orderBy("container").collect()]
    assert got == [(0, 0, 1000), (1, 1000, 1000), (2, 2000, 1000), (3, 3000, 410)]


def test_numbers_in_order_by_ranges(spark):
    from readloom.operators.cuts import numbered

    got = numbered(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")), ["v"], slices=7).orderBy("v").collect()
    assert [r.place for r in got] == list(range(1, 1001)) and numbered(spark.range(0), ["id"]).isEmpty()


def test_windows_of_a_contig_give_the_same_as_the_whole(spark):
    from readloom.operators import lossy

    letters = "".join(random.Random(3).choices("ACGT", k=1000))
    ref = spark.createDataFrame([(0, "r", letters), (1, "other", "ACGT")], "ref_id int, rname string, seq string")
    g = random.Random(4)
    rows = []
    for _ in range(60):
        pos = g.randrange(1, 950)
        s = "".join(x if g.random() < 0.9 else "T" for x in letters[pos - 1 : pos + 19]).ljust(20, "A")
        rows.append((pos, s, g.choice(["20M", "8M30N12M", "5S10M2D5M", "8M300N12M", "3M2I15M", "10M5S5H"])))
    r = table(spark, rows).withColumns({"seq": F.expr("case when cigar = '10M5S5H' then left(seq, 15) else seq end"), "mapq": F.lit(9)}).withColumn("qual", F.expr("repeat('5', length(seq))"))
    same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    for tile in (64, 400):
        for f in (pileup.aligned_bases, pileup.md_nm, pileup.substitutions, features.read_features, lossy.base_table):
            assert same(f(r, ref, tile), f(r, ref)), (f, tile)
        assert same(lossy.apply(r, ref, "R8-N40-D40", tile), lossy.apply(r, ref, "R8-N40-D40"))
        assert same(features.restore_bases(r, features.read_features(r, ref, tile), ref, tile), r.select("rec_idx", "seq"))


def test_reads_are_not_the_broadcast_side(spark):
    from readloom.plans.fixtures import reads as fixture

    plan = fixture(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    built = [x for x in plan.splitlines() if "BroadcastHashJoin" in x][0]
    assert "BuildRight" in built


def test_table_of_differences(spark):
    from readloom.operators import diff

    r = reads(spark).withColumn("tags", F.create_map(F.lit("NM"), F.struct(F.lit("i").alias("type"), F.lit("1").alias("value"))))
    n = r.count()
    b = r.where(f"rec_idx < {n - 2}").withColumn("mapq", F.expr("case when rec_idx = 1 then mapq + 1 else mapq end"))
    d = diff.discrepancies(r, b, text.sam_lines).orderBy("counter").collect()
    assert [(x.counter, x.field, x.premature) for x in d] == [(1, "mapq", 0), (n - 2, None, 2), (n - 1, None, 2)]
    assert d[0].record1 != d[0].record2 and d[1].record2 is None and d[1].record1
    assert [x.premature for x in diff.discrepancies(b, r).where("premature > 0").collect()] == [1, 1]


def _bam_of(tmp_path, n, block, seed=5):
    """A BAM file of small blocks with records of many lengths, some longer than a block."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        size = r.choice([0, 1, 7, 40, 40, 40, 3000])
        placed = r.random() < 0.9
        rows.append({
            "qname": f"q{i}", "flag": 0 if placed and size else 4, "rname": f"chr{1 + i * 3 // n}" if placed else "*", "pos": 1 + (i * 40 % 60_000_000) * 7 % 400_000 if placed else 0, "mapq": i % 60,
            "cigar": f"{size}M" if size and placed else "*", "rnext": "*", "pnext": 0, "tlen": 0, "seq": "".join(r.choice("ACGT") for _ in range(size)) or "*", "qual": "".join(chr(33 + r.randrange(40)) for _ in range(size)) or "*",
            "tags": {"NM": {"type": "i", "value": str(i)}},
        })
    rows.sort(key=lambda x: (x["rname"] == "*", x["rname"], x["pos"]))
    refs = [("chr1", 500_000), ("chr2", 500_000), ("chr3", 500_000)]
    raw = bam.inflate(bam.encode(rows, refs, "@HD\tVN:1.6\n"))
    path = tmp_path / "sorted.bam"
    path.write_bytes(bam.deflate(raw, block))
    return path, rows


def test_bam_is_read_by_several_tasks(spark, tmp_path):
    path, rows = _bam_of(tmp_path, 3000, 700)
    want = [x["qname"] for x in rows]
    for split in (900, 10_000, 1 << 30):
        got = bam.read_bam(spark, str(path), split=split)
        assert got.rdd.getNumPartitions() == -(-path.stat().st_size // split) if split > 900 else True
        assert [r.qname for r in got.select("qname", "rec_idx").orderBy("rec_idx").collect()] == want
    got = bam.read_bam(spark, str(path), split=5000, offsets=True).orderBy("rec_idx").select("voffset", "vend").collect()
    assert all(a.vend == b.voffset for a, b in zip(got, got[1:], strict=False)) and len(got) == len(want)


def test_bai_is_built_by_tasks_read_and_used(spark, tmp_path):
    path, rows = _bam_of(tmp_path, 2500, 2000)
    got = {}
    for split in (9000, 1 << 30):
        made = bai.to_bai(bai.index_rows(spark, str(path), split=split)).collect()
        assert len(made) == 1
        (tmp_path / f"{split}.bai").write_bytes(bytes(made[0].content))
        got[split] = bai.parse(bytes(made[0].content))
    assert got[9000] == got[1 << 30]  # how a file is dealt to tasks doesn't matter
    kinds = {(k, r): (b, e) for k, r, _, b, e in got[9000] if k in ("count", "loose", "refs")}
    for i in range(3):
        own = [x for x in rows if x["rname"] == f"chr{i + 1}"]
        assert kinds["count", i] == (sum(not x["flag"] & 4 for x in own), sum(bool(x["flag"] & 4) for x in own))
    assert kinds["loose", -1][0] == sum(x["rname"] == "*" for x in rows) and kinds["refs", -1][0] == 3
    size = lambda x: 1 if x["flag"] & 4 else max(1, len(x["seq"]))
    for rname, start, stop in (("chr1", 1, 500_000), ("chr2", 100_000, 100_900), ("chr3", 16_384, 16_385), ("chr2", 499_000, 500_000)):
        want = [x["qname"] for x in rows if x["rname"] == rname and x["pos"] <= stop and x["pos"] + size(x) - 1 >= start]
        region = bai.read_region(spark, str(path), str(tmp_path / "9000.bai"), rname, start, stop)
        assert [r.qname for r in region.orderBy("rec_idx").collect()] == want
    near = bai.places(bai.read_bai(spark, str(tmp_path / "9000.bai")), 1, 100_000, 100_900)
    assert sum((e >> 16) - (b >> 16) for b, e in near) < path.stat().st_size / 2  # most of the file is left out
    with pytest.raises(ValueError):
        bai.parse(b"BAM\1")


def test_stretches_of_fasta_by_place(spark, tmp_path):
    r = random.Random(3)
    contigs = {f"c{i}": "".join(r.choice("ACGTN") for _ in range(n)) for i, n in enumerate((1, 60, 61, 5000))}
    raw, fai = "", []
    for name, s in contigs.items():
        raw += f">{name}\n"
        fai.append((name, len(s), len(raw), 60, 61))
        raw += "".join(s[i : i + 60].lower() + "\n" for i in range(0, len(s), 60))
    (tmp_path / "a.fa").write_text(raw)
    (tmp_path / "a.fa.gz").write_bytes(bam.deflate(raw.encode(), 333))
    index = spark.createDataFrame(fai, "rname string, length int, start long, line_bases int, line_bytes int")
    spots = [("c0", 1, 1), ("c1", 60, 60), ("c2", 60, 61), ("c2", 61, 99), ("c3", 1, 5000), ("c3", 4700, 4999), ("c3", 5001, 5002), ("c9", 1, 2), ("c1", 0, 5)]
    spots += [("c3", a := r.randint(1, 5000), a + r.randint(0, 300)) for _ in range(30)]
    want = sorted((n, a, b, contigs[n][a - 1 : b] if n in contigs and 1 <= a <= len(contigs[n]) else None) for n, a, b in spots)
    for name in ("a.fa", "a.fa.gz"):
        got = fasta.regions(spark, str(tmp_path / name), index, spark.createDataFrame(spots, "rname string, start long, stop long"), 3)
        assert sorted(tuple(x) for x in got.collect()) == want


def test_references_by_checksum(spark, tmp_path):
    data = {hashlib.md5(s.encode()).hexdigest(): s for s in ("ACGT", "GGNN", "not a sequence!")}
    a, b, junk = data
    for folder, md5 in (("one", a), ("two", a), ("two", b), ("two", junk)):
        p = tmp_path / folder / md5[:2] / md5[2:]
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(data[md5])
    wanted = spark.createDataFrame([(x,) for x in (a, b.upper(), junk, "0" * 32, None)], "md5 string")
    local = [f"{tmp_path}/{f}/%2s/%s" for f in ("one", "two")]
    got = {x.md5: (x.path and x.path.split("/")[-3], x.seq) for x in fasta.find_by_md5(wanted, local).collect()}
    assert got == {a: ("one", "ACGT"), b: ("two", "GGNN"), junk: ("two", "not a sequence!"), "0" * 32: (None, None), None: (None, None)}
    remote = {x.md5: x.seq for x in fasta.find_by_md5(wanted, ["file://" + p for p in local]).collect()}
    assert remote[a] == "ACGT" and remote[junk] is None  # what comes from elsewhere must look like a sequence
    (tmp_path / "one" / b[:2]).mkdir(exist_ok=True)
    (tmp_path / "one" / b[:2] / b[2:]).write_text("other")
    with pytest.raises(Exception, match="checksum"):
        fasta.find_by_md5(wanted, local).collect()


def test_packed_places_of_reads(spark):
    rows = [(0, 0, 0), (1, 2, 3), (0xFFFFFF, 0xFFFF, 0xFFFFFF), (5, 0xFFFF, 0)]
    d = spark.createDataFrame(rows, "a int, b int, c int")
    assert [tuple(x) for x in d.select(*fastq.unpacked_place(fastq.packed_place(F.col("a"), F.col("b"), F.col("c")))).collect()] == rows


def _varint(v):
    v &= 0xFFFFFFFF
    if v < 1 << 7:
        return bytes([v])
    if v < 1 << 14:
        return bytes([0x80 | v >> 8, v & 255])
    if v < 1 << 21:
        return bytes([0xC0 | v >> 16, v >> 8 & 255, v & 255])
    if v < 1 << 28:
        return bytes([0xE0 | v >> 24]) + (v & 0xFFFFFF).to_bytes(3, "big")
    return bytes([0xF0 | v >> 28, v >> 20 & 255, v >> 12 & 255, v >> 4 & 255, v & 15])


def _long_varint(v):
    for more in range(9):
        if more == 8 or v < 1 << (7 * (more + 1)):
            whole = v.to_bytes(more, "big") if more >= 7 else (v & (1 << 8 * more) - 1).to_bytes(more, "big")
            return bytes([(0xFF << (8 - more)) & 255 | (v >> 8 * more if more < 7 else 0)]) + whole


@pytest.mark.parametrize("major", [2, 3])
def test_cram_containers(spark, tmp_path, major):
    kept = [(-1, 0, 0, 0, 0, 0, 1, [0]), (0, 100, 5000, 10_000, 0, 1_000_000, 3, [17, 300]), (0, 5100, 200_000, 9, 10_000, 900, 2, [5] * 700), (-2, 0, 0, 70, 10_009, 1 << 20, 2, [3]), (1, 1 << 28, 1 << 29, 5, 10_079, (1 << 33) + 5, 2, [9])]
    out, parts = b"CRAM" + bytes([major, 1 if major == 2 else 0]) + bytes(20), []
    for i, (ref, start, span, n, counter, bases, blocks, marks) in enumerate(kept):
        body = bytes([i]) * (50 + 1000 * i)
        h = len(body).to_bytes(4, "little") + b"".join(map(_varint, (ref, start, span, n))) + (_long_varint if major == 3 else _varint)(counter) + _long_varint(bases) + b"".join(map(_varint, (blocks, len(marks), *marks)))
        parts.append((h + zlib.crc32(h).to_bytes(4, "little") if major == 3 else h) + body)
    whole = out + b"".join(parts) + bytes.fromhex(cram.ENDS[major])
    (tmp_path / "a.cram").write_bytes(whole)
    (tmp_path / "b.cram").write_bytes(whole[: -len(cram.ENDS[major]) // 2])
    found = cram.containers(spark, str(tmp_path / "a.cram"))
    rows = found.orderBy("container").collect()
    assert [(r.ref, r.start, r.span, r.n, r.counter, r.bases, r.blocks, r.landmarks) for r in rows] == kept
    assert [bytes(r.content) for r in cram.raw(found, 3).orderBy("container").collect()] == parts
    assert [tuple(r)[1:] for r in cram.counts(found).collect()] == [(10_084, 1_000_900 + (1 << 20) + (1 << 33) + 5)]
    ids = lambda d: sorted(r.container for r in d.collect())
    assert ids(cram.overlapping(found, 0, 5099, 5099)) == [1, 3] and ids(cram.overlapping(found, 0, 5099, 5100)) == [1, 2, 3] and ids(cram.first(found, 2)) == [1, 2]
    assert {r.path[-6:]: r.complete for r in text.is_complete(spark, f"{tmp_path}/*.cram").collect()} == {"a.cram": True, "b.cram": False}
    assert {r.format for r in text.detect_format(spark, f"{tmp_path}/*.cram").collect()} == {"CRAM"}
    (tmp_path / "c.cram").write_bytes(whole[:3000])
    with pytest.raises(Exception, match="ends within"):
        cram.containers(spark, str(tmp_path / "c.cram")).collect()


def test_headers_are_fixed(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n@SQ\tSN:c1\tLN:5\tM5:bad\tAS:x\n@SQ\tSN:c2\tLN:7\n@RG\tID:g\tSM:s\n@PG\tID:tool\tPN:tool\n@CO\tkept: as it is\n")
    d = spark.createDataFrame([("c1", 6, "good", "file://r.fa"), ("c9", 1, None, None)], "rname string, length int, md5 string, uri string")
    h = text.fixed_header(text.read_sam_header(spark, str(tmp_path / "a.sam")), d, {"ID": "tool", "VN": "2"}, {"ID": "g", "SM": "t"})
    assert [x.line for x in text.header_lines(h).orderBy("rec_idx").collect()] == [
        "@HD\tVN:1.6", "@SQ\tSN:c1\tAS:x\tLN:6\tM5:good\tUR:file://r.fa", "@SQ\tSN:c2\tLN:7", "@PG\tID:tool\tPN:tool", "@CO\tkept: as it is",
        "@RG\tID:g\tSM:t", "@PG\tID:tool.1\tVN:2\tPP:tool",
    ]
