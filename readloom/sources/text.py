"""Text formats of sequencing data as DataFrames, read and written by Spark alone, so paths may lie in any store that it knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.schema import FIELDS
from readloom.sources import ranges

_INT = ("flag", "pos", "mapq", "pnext", "tlen")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line and rec_idx: lines in file order. Numbers are dense within a partition and rise with it; they order records without a pass of counting."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("rec_idx"))


def dense_numbers(df: DataFrame, column: str = "rec_idx") -> DataFrame:
    """Rising numbers made 0, 1, 2, ...: rows are numbered in ranges, and ranges start where those before them end."""
    from pyspark.sql import Window

    part = F.shiftright(column, 33)
    size = df.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(F.col(column)).alias("low"))
    base = size.select("part", F.coalesce(F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row for each input partition
    inside = F.row_number().over(Window.partitionBy(part).orderBy(column)) - 1
    return df.withColumns({"part": part, "__at": inside}).join(F.broadcast(base), "part").withColumn(column, F.col("base") + F.col("__at")).drop("part", "__at", "base")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM text with READ_SCHEMA; header lines are left out. Tags of any number come as a map."""
    lines = numbered_lines(spark, path).where(~F.col("line").startswith("@") & (F.col("line") != ""))
    parts = F.split("line", "\t")
    cols = [(parts[i].cast("int") if c in _INT else parts[i]).alias(c) for i, c in enumerate(FIELDS.values())]
    tag = lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.struct(F.substring(t, 4, 1).alias("type"), F.substring(t, 6, 1 << 30).alias("value")).alias("value"))
    return lines.select(*cols, F.map_from_entries(F.transform(F.slice(parts, 12, 1 << 20), tag)).alias("tags"), "rec_idx")


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """kind, name, fields (map) of header lines: @HD, @SQ, @RG, @PG, @CO. name is SN of @SQ, ID of @RG and @PG."""
    lines = numbered_lines(spark, path).where(F.col("line").rlike("^@[A-Z]{2}\t"))
    parts = F.split("line", "\t")
    kind = F.substring(parts[0], 2, 2)
    pairs = F.map_from_entries(F.transform(F.filter(F.slice(parts, 2, 1 << 20), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:")), lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, 4, 1 << 30))))
    fields = F.when(kind == "CO", F.create_map(F.lit("CO"), F.substring("line", 5, 1 << 30))).otherwise(pairs)
    return lines.select(kind.alias("kind"), fields.alias("fields"), "rec_idx").withColumn("name", F.coalesce(F.try_element_at("fields", F.lit("SN")), F.try_element_at("fields", F.lit("ID"))))


def fixed_header(header: DataFrame, dictionary: DataFrame | None = None, program: dict[str, str] | None = None, read_group: dict[str, str] | None = None) -> DataFrame:
    """A header (as read_sam_header gives it) with LN, M5 and UR of contigs as a dictionary has them (rname, length, md5, uri; nulls and absent contigs change nothing), a @PG line for `program` and a @RG line for `read_group`.

    The program follows the last one of the header (PP); where its ID is taken it gets the first free of ID.1, ID.2, ... . A read group whose ID
    is there replaces that line. New lines come last of their kind's place in the file, in the order @RG, @PG.
    """
    spark, h = header.sparkSession, header.select("kind", "fields", "rec_idx", "name")
    if dictionary is not None:
        new = F.map_filter(F.create_map(F.lit("LN"), F.col("length").cast("string"), F.lit("M5"), F.col("md5"), F.lit("UR"), F.col("uri")), lambda k, v: v.isNotNull())
        d = dictionary.select(F.col("rname").alias("name"), new.alias("new"), F.lit("SQ").alias("kind"))
        kept = lambda: F.map_filter("fields", lambda k, v: ~F.map_contains_key("new", k))
        h = h.join(d, ["kind", "name"], "left").select("kind", F.when(F.col("new").isNull(), F.col("fields")).otherwise(F.map_concat(kept(), "new")).alias("fields"), "rec_idx", "name")
    last = h.agg(F.max("rec_idx")).collect()[0][0] or 0
    extra = []
    if read_group:
        h = h.where(~((F.col("kind") == "RG") & F.col("name").eqNullSafe(read_group["ID"])))
        extra.append(("RG", read_group, last + 1, read_group["ID"]))
    if program:
        known = [r.name for r in h.where("kind = 'PG'").orderBy("rec_idx").select("name").collect()]  # one row for each program that made the file
        ident = next(i for i in [program["ID"], *(f"{program['ID']}.{k}" for k in range(1, len(known) + 2))] if i not in known)
        extra.append(("PG", {**program, "ID": ident, **({"PP": known[-1]} if known else {})}, last + 2, ident))
    for kind, fields, at, ident in extra:
        own = F.create_map(*(F.lit(x) for pair in fields.items() for x in pair))
        h = h.unionByName(spark.range(1).select(F.lit(kind).alias("kind"), own.alias("fields"), F.lit(at).cast("long").alias("rec_idx"), F.lit(ident).alias("name")))
    return h


def header_lines(header: DataFrame) -> DataFrame:
    """line and rec_idx of a header's rows; the naming field comes first, the others in their order."""
    lead = F.when(F.col("kind") == "SQ", "SN").when(F.col("kind").isin("RG", "PG"), "ID").when(F.col("kind") == "HD", "VN").otherwise("")
    pairs = F.map_entries("fields")
    text = lambda e: F.concat(e["key"], F.lit(":"), e["value"])
    ordered = F.concat(F.filter(pairs, lambda e: e["key"] == lead), F.filter(pairs, lambda e: e["key"] != lead))
    line = F.when(F.col("kind") == "CO", F.concat(F.lit("@CO\t"), F.try_element_at("fields", F.lit("CO")))).otherwise(F.concat_ws("\t", F.concat(F.lit("@"), "kind"), F.transform(ordered, text)))
    return header.select(line.alias("line"), "rec_idx")


def sam_lines(reads: DataFrame) -> Column:
    """One SAM line for each record; absent columns are written as missing."""
    missing = {"rnext": "*", "pnext": "0", "tlen": "0", "qual": "*", "seq": "*"}
    cols = [F.coalesce(F.col(c).cast("string"), F.lit(missing.get(c, "*"))) if c in reads.columns else F.lit(missing.get(c, "*")) for c in FIELDS.values()]
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"])) if "tags" in reads.columns else F.array().cast("array<string>")
    return F.concat_ws("\t", *cols, tags)


def write_sam(reads: DataFrame, path: str, header: list[str] | None = None) -> None:
    """SAM text as part files in record order; header lines, if any, come in a first file of their own."""
    body = reads.select(sam_lines(reads).alias("value"), "rec_idx").orderBy("rec_idx").select("value")
    if header:
        spark = reads.sparkSession
        spark.createDataFrame([(h,) for h in header], "value string").coalesce(1).write.mode("overwrite").text(path)
        body.write.mode("append").text(path)
    else:
        body.write.mode("overwrite").text(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """rec_idx, name, segment, seq, qual of FASTQ files; rec_idx rises in file order.

    The reader cuts files at line ends that are followed by `@`, which every record begins with. Scores may begin with `@` too; such
    a record comes in two pieces, three lines and the rest of its scores. Whole records stay where they are read; only pieces (with
    scores of even use one record in forty) are put in order, by input partition, and of these one record at most for each partition's end
    meets the piece that the next partition begins with. Pieces that nothing belongs to are left out.
    """
    from pyspark.sql import Window

    raw = spark.read.option("lineSep", "\n@").text(path).select(F.regexp_replace("value", "\n$", "").alias("piece"), F.monotonically_increasing_id().alias("rec_idx"))
    lines = F.split("piece", "\n")
    head = F.regexp_replace(lines[0], "^@", "").alias("head")  # a file's first record has its mark still
    whole = raw.where(F.size(lines) == 4).select("rec_idx", head, lines[1].alias("seq"), lines[3].alias("qual"))
    is_head, rest = F.size(lines) == 3, F.concat(F.lit("@"), "next.piece")
    after = F.lead(F.struct("rec_idx", "piece"))
    pieces = raw.where(F.size(lines).isin(1, 3)).withColumn("next", after.over(Window.partitionBy(F.shiftright("rec_idx", 33)).orderBy("rec_idx")))
    inside = pieces.where(is_head & (F.col("next.rec_idx") == F.col("rec_idx") + 1))
    first = F.col("rec_idx").bitwiseAND((1 << 33) - 1) == 0  # of its partition
    ends = pieces.where(F.when(is_head, F.col("next").isNull()).otherwise(first)).withColumn("next", after.over(Window.orderBy("rec_idx")))  # two rows at most for each partition
    across = ends.where(is_head & (F.size(F.split("next.piece", "\n")) == 1))
    mended = inside.unionByName(across).select("rec_idx", head, lines[1].alias("seq"), rest.alias("qual"))
    seg = F.regexp_extract("head", "/([12])$", 1)
    return whole.unionByName(mended).select("rec_idx", F.regexp_replace("head", "/[12]$", "").alias("name"), F.when(seg == "", 0).otherwise(seg.try_cast("int")).alias("segment"), "seq", "qual")


def write_fastq(records: DataFrame, path: str, gzip: bool = True) -> None:
    """Records (segment, record, rec_idx) as text by segment; a segment without records has no files."""
    out = records.select("segment", F.regexp_replace("record", "\n$", "").alias("value"), "rec_idx").repartitionByRange("segment", "rec_idx").sortWithinPartitions("segment", "rec_idx").drop("rec_idx")
    out.write.mode("overwrite").partitionBy("segment").option("compression", "gzip" if gzip else "none").text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """rname, seq (upper case), description: contigs of FASTA files, cut at `>`."""
    raw = spark.read.option("lineSep", ">").text(path).where("length(value) > 0")
    head = F.regexp_extract("value", "^([^\n]*)", 1)
    return raw.select(F.regexp_extract(head, r"^(\S+)", 1).alias("rname"), F.upper(F.regexp_replace(F.regexp_replace("value", "^[^\n]*\n?", ""), r"\s", "")).alias("seq"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"))


def read_fasta_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Contigs of all .fa and .fasta files below a folder, with their file."""
    raw = spark.read.option("lineSep", ">").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{fa,fasta}").text(folder).withColumn("file", F.input_file_name()).where("length(value) > 0")
    return raw.select("file", F.regexp_extract("value", r"^(\S+)", 1).alias("rname"), F.upper(F.regexp_replace(F.regexp_replace("value", "^[^\n]*\n?", ""), r"\s", "")).alias("seq"))


CRAI = "seq_id int, start int, span int, container_offset long, slice_offset int, size int"


def read_crai(spark: SparkSession, path: str) -> DataFrame:
    """Index rows; a line without exactly six columns is an error."""
    parts = F.split("value", "\t")
    checked = F.when(F.size(parts) == 6, parts).otherwise(F.raise_error(F.concat(F.lit("not an index line: "), "value")).cast("array<string>"))
    kinds = [x.split() for x in CRAI.split(", ")]
    return spark.read.text(path).where("value <> ''").select(*(checked[i].cast(k).alias(n) for i, (n, k) in enumerate(kinds)))


def write_crai(index: DataFrame, path: str) -> None:
    from readloom.operators.index import index_order

    index.select("seq_id", "start", "span", "container_offset", "slice_offset", "size").orderBy(*index_order()).write.mode("overwrite").csv(path, sep="\t", compression="gzip")


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rname string, length int, start long, line_bases int, line_bytes int").csv(path, sep="\t")


def write_fai(fai: DataFrame, path: str) -> None:
    fai.select("rname", "length", "start", "line_bases", "line_bytes").orderBy("start").coalesce(1).write.mode("overwrite").csv(path, sep="\t")  # one row for each contig


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """line number, format and positions of mask lines."""
    from readloom.operators import masks

    kind = masks.detect(F.col("line"))
    return numbered_lines(spark, path).select("rec_idx", kind.alias("kind"), F.when(kind == "letters", masks.from_letters(F.col("line"))).when(kind == "integers", masks.from_integers(F.col("line"))).alias("mask"))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence rows: tab-separated (bzip2 is read as it is), `#` lines are the header and `>` names the columns."""
    from readloom.operators.evidence import COLUMNS

    rows = spark.read.text(path).where("value <> '' and not startswith(value, '#') and not startswith(value, '>')")
    parts = F.split("value", "\t", -1)
    return rows.select(*(parts[i].alias(c) for i, c in enumerate(COLUMNS)))


def evidence_header(spark: SparkSession, path: str) -> DataFrame:
    """key and value of the `#KEY<tab>VALUE` lines."""
    lines = spark.read.text(path).where("startswith(value, '#')")
    return lines.select(F.regexp_extract("value", "^#([^\t]+)", 1).alias("key"), F.regexp_extract("value", "\t(.*)$", 1).alias("value"))


def detect_format(spark: SparkSession, path: str) -> DataFrame:
    """path and format: by first bytes, else by extension, else UNKNOWN."""
    b = ranges.edges(spark, path, 4, 0)
    magic = F.hex("head")
    by_name = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(magic.startswith("404844") | magic.startswith("405351"), "SAM").when(magic.startswith("1F8B"), F.when(by_name == "bam", "BAM").otherwise("GZIP")).when(magic == "4352414D", "CRAM")
    return b.select("path", kind.when(by_name.isin("sam", "bam", "cram"), F.upper(by_name)).otherwise("UNKNOWN").alias("format"))


def is_complete(spark: SparkSession, path: str) -> DataFrame:
    """path and complete: whether a file ends with the mark of its end, the empty block of a block-compressed file or the last container of a CRAM file's version. CRAM files before 2.1 have no mark and count as complete."""
    from readloom.sources.cram import ENDS

    block = "1F8B08040000000000FF0600424302001B0003000000000000000000"
    head, tail = F.hex("head"), F.hex("tail")
    major, minor = F.ascii(F.substring("head", 5, 1)), F.ascii(F.substring("head", 6, 1))
    of_cram = F.when((major < 2) | ((major == 2) & (minor < 1)), True).when(major == 2, tail.endswith(ENDS[2])).otherwise(tail.endswith(ENDS[3]))
    return ranges.edges(spark, path, 6, 40).select("path", F.when(head.startswith("4352414D"), of_cram).otherwise(tail.endswith(block)).alias("complete"))


def index_candidates(path: str) -> list[str]:
    """Names under which a file's index may lie."""
    stem, dot, ext = path.rpartition(".")
    stems = [path] + ([stem] if dot and ext.lower() in ("bam", "cram", "cram2", "cram3") else [])
    return [s + e for s in stems for e in (".bai", ".BAI", ".crai", ".CRAI")]


def encrypted(df: DataFrame, column: str, key: str) -> DataFrame:
    """A column sealed with AES (GCM); decrypted() opens it with the same key."""
    return df.withColumn(column, F.base64(F.aes_encrypt(F.col(column).cast("binary"), F.lit(key))))


def decrypted(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.withColumn(column, F.aes_decrypt(F.unbase64(column), F.lit(key)).cast("string"))
