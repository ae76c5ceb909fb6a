"""Scalar functions on sequences, names and paths, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IUPAC = "ACGTURYSWKMBDHVN.-"


def reverse_complement(s: Column) -> Column:
    """Complement keeps case; other letters stay."""
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def normalize(s: Column) -> Column:
    """acgt to upper case, everything else to N."""
    return F.regexp_replace(F.translate(s, "acgt", "ACGT"), "[^ACGT]", "N")


def normalize_strict(s: Column) -> Column:
    """As normalize(), but a letter other than ACGTN in either case is an error."""
    return F.when(s.rlike("[^ACGTNacgtn]"), F.raise_error(F.concat(F.lit("not a base in "), s)).cast("string")).otherwise(normalize(s))


def is_valid(s: Column, first: int = 1000) -> Column:
    """Whether the first letters are IUPAC codes (either case), `.` or `-`."""
    return F.substring(F.upper(s), 1, first).rlike(r"^[ACGTURYSWKMBDHVN.\-]*$")


def nybbles(s: Column) -> Column:
    """Bases as 4-bit codes, two to a byte, first base high; the odd last one is padded with 0. Letters without a code become N (15)."""
    codes = "=ACMGRSVTWYHKDBN"
    known = F.translate(F.regexp_replace(F.upper(s), "[^=ACMGRSVTWYHKDBN]", "N"), codes, "0123456789ABCDEF")
    return F.unhex(F.concat(known, F.when(F.length(s) % 2 == 1, "0").otherwise("")))


def from_nybbles(b: Column, length: Column) -> Column:
    return F.translate(F.substring(F.hex(b), F.lit(1), length.cast("int")), "0123456789ABCDEF", "=ACMGRSVTWYHKDBN")


def file_name(path: Column) -> Column:
    """The last element of a path or URL."""
    return F.regexp_extract(path, "([^/]+)$", 1)


def path_of(pattern: str, ident: Column) -> Column:
    """Fill a path pattern: `%2s` takes the next two characters of the id, `%s` all that are left; one `%s` is required."""
    import re

    if "%s" not in pattern:
        raise ValueError(f"no %s in {pattern!r}")
    parts, at = [], 1
    for piece in re.findall(r"%\d*s|[^%]+", pattern):
        if not piece.startswith("%"):
            parts.append(F.lit(piece))
        elif piece == "%s":
            parts.append(F.substring(ident, at, 1 << 20))
        else:
            parts.append(F.substring(ident, at, int(piece[1:-1])))
            at += int(piece[1:-1])
    return F.concat(*parts)


def seq_id(name: Column) -> Column:
    """A name that ends in 32 hex digits: its md5, and the name before it."""
    return F.struct(F.right(name, F.lit(32)).alias("md5"), F.left(name, F.length(name) - 32).alias("name"))


def version_parts(v: Column) -> Column:
    """Version text split at `.`, `-` and `b`, as integers; an empty part is null. Major and minor are the first two, the build after `-b` is the fourth."""
    return F.transform(F.split(v, "[.b-]"), lambda x: x.try_cast("int"))


def name_order(name: Column) -> list[Column]:
    """Sort keys: length, then characters from the last one on."""
    return [F.length(name), F.reverse(name)]


def reformat_date(text: Column, fmt: str = "yyyy-MMM-dd hh:mm:ss.S") -> Column:
    return F.date_format(F.to_timestamp(text, fmt), "yyyy-MM-dd")
