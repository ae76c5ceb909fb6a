"""Schemas and flag bits of alignment records."""

from __future__ import annotations

from pyspark.sql import types as T

#: Flag bits of an alignment record (fixed values of the SAM format).
FLAGS = {
    "paired": 0x1, "proper_pair": 0x2, "unmapped": 0x4, "mate_unmapped": 0x8, "reverse": 0x10, "mate_reverse": 0x20,
    "first": 0x40, "second": 0x80, "secondary": 0x100, "qc_fail": 0x200, "duplicate": 0x400, "supplementary": 0x800,
}
NOT_PRIMARY = FLAGS["secondary"] | FLAGS["supplementary"]

#: The eleven fields, by the names that selectors use, with our column of each.
FIELDS = {"QNAME": "qname", "FLAG": "flag", "RNAME": "rname", "POS": "pos", "MAPQ": "mapq", "CIGAR": "cigar", "RNEXT": "rnext", "PNEXT": "pnext", "TLEN": "tlen", "SEQ": "seq", "QUAL": "qual"}

TAG = T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])
READ_SCHEMA = T.StructType(
    [T.StructField(c, T.IntegerType() if c in ("flag", "pos", "mapq", "pnext", "tlen") else T.StringType()) for c in FIELDS.values()]
    + [T.StructField("tags", T.MapType(T.StringType(), TAG)), T.StructField("rec_idx", T.LongType())]
)
REF_SCHEMA = "ref_id int, rname string, length int, md5 string, uri string, seq string"
