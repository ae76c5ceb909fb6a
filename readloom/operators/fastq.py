"""FASTQ and FASTA records from and to reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.flags import has, segment
from readloom.functions.seq import reverse_complement
from readloom.operators.filters import primary


def as_sequenced(reads: DataFrame) -> DataFrame:
    """Bases and scores of reads on the reverse strand turned back to the order of sequencing."""
    turned = has(F.col("flag"), 16)
    return reads.withColumns({"seq": F.when(turned, reverse_complement(F.col("seq"))).otherwise(F.col("seq")), "qual": F.when(turned, F.reverse("qual")).otherwise(F.col("qual"))})


def _name(name: Column, seg: Column) -> Column:
    return F.concat(name, F.when(seg == 0, "").otherwise(F.concat(F.lit("/"), seg.cast("string"))))


def fastq_records(reads: DataFrame, reverse: bool = False, name: str = "qname") -> DataFrame:
    """`segment` and `record` (text) of primary reads; missing scores are written `!`."""
    r = as_sequenced(primary(reads)) if reverse else primary(reads)
    seg = segment(F.col("flag"))
    scores = F.when(F.col("qual").isNull() | (F.col("qual") == "*"), F.expr("repeat('!', length(seq))")).otherwise(F.col("qual"))
    return r.withColumns({"segment": seg, "record": F.concat(F.lit("@"), _name(F.col(name), seg), F.lit("\n"), "seq", F.lit("\n+\n"), scores, F.lit("\n"))})


def fasta_records(reads: DataFrame) -> DataFrame:
    r, seg = primary(reads), segment(F.col("flag"))
    return r.withColumns({"segment": seg, "record": F.concat(F.lit(">"), _name(F.col("qname"), seg), F.lit("\n"), "seq", F.lit("\n"))})


def parse_records(records: DataFrame, column: str = "record") -> DataFrame:
    """name, segment, seq, qual of four-line records; /1 and /2 go from the name to the segment."""
    lines = F.split(column, "\n")
    head = F.regexp_extract(lines[0], "^@(.*)$", 1)
    seg = F.regexp_extract(head, "/([12])$", 1)
    return records.select(F.regexp_replace(head, "/[12]$", "").alias("name"), F.when(seg == "", 0).otherwise(seg.try_cast("int")).alias("segment"), lines[1].alias("seq"), lines[3].alias("qual"))


def to_unmapped(fastq: DataFrame) -> DataFrame:
    """Unmapped records of FASTQ reads, with the bits of a pair where there is a segment."""
    flag = F.when(F.col("segment") == 0, 4).when(F.col("segment") == 1, 4 + 1 + 8 + 64).otherwise(4 + 1 + 8 + 128)
    return fastq.select(
        F.col("name").alias("qname"), flag.alias("flag"), F.lit("*").alias("rname"), F.lit(0).alias("pos"), F.lit(0).alias("mapq"), F.lit("*").alias("cigar"),
        F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), "seq", "qual",
    )


def reads_per_bytes(records: DataFrame, budget: int, column: str = "record") -> DataFrame:
    """How many records fit a buffer of `budget` bytes by their mean size, and the exact number of records."""
    return records.agg(F.floor(F.lit(budget) / F.avg(F.octet_length(column))).cast("long").alias("fit"), F.count("*").alias("n"))


def packed_place(offset: Column, name_length: Column, read_length: Column) -> Column:
    """A read's place in a buffer as one long: 24 bits of offset, 16 of the name's length, 24 of the read's."""
    return F.shiftleft(offset.cast("long"), 40).bitwiseOR(F.shiftleft(name_length.cast("long").bitwiseAND(0xFFFF), 24)).bitwiseOR(read_length.cast("long").bitwiseAND(0xFFFFFF))


def unpacked_place(entry: Column) -> list[Column]:
    """offset, name_length and read_length of packed_place()."""
    return [
        F.shiftrightunsigned(entry, 40).cast("int").alias("offset"), F.shiftright(entry, 24).bitwiseAND(0xFFFF).cast("int").alias("name_length"),
        entry.bitwiseAND(0xFFFFFF).cast("int").alias("read_length"),
    ]
