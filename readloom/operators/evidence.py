"""Evidence rows of half-dupleted reads: two records for each row, and CIGARs with overlaps."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of an evidence file, in order (fixed by the format).
COLUMNS = (
    "IntervalId", "Chromosome", "Slide", "Lane", "FileNumInLane", "DnbOffsetInLaneFile", "AlleleIndex", "Side", "Strand", "OffsetInAllele", "AlleleAlignment", "OffsetInReference", "ReferenceAlignment",
    "MateOffsetInReference", "MateReferenceAlignment", "MateStrand", "MappingQuality", "MappingQualityScore", "ScoreAllele0", "ScoreAllele1", "ScoreAllele2",
)


def read_name(e: DataFrame) -> Column:
    return F.format_string("%s-%s-%s:%s", e["Slide"], e["Lane"], e["FileNumInLane"], e["DnbOffsetInLaneFile"])


def records(evidence: DataFrame) -> DataFrame:
    """Two records for each row, the read and its mate: qname, flag, rname, pos (1-based), mapq, cigar, side."""
    minus, mate_minus = F.col("Strand") == "-", F.col("MateStrand") == "-"
    left = F.col("Side") == "L"
    flag = lambda own, other, first: (F.lit(3) + F.when(own, 16).otherwise(0) + F.when(other, 32).otherwise(0) + F.when(first, 64).otherwise(128)).cast("int")
    q = F.ascii("MappingQuality") - 33
    one = F.struct(flag(minus, mate_minus, left).alias("flag"), (F.col("OffsetInReference").cast("int") + 1).alias("pos"), F.col("ReferenceAlignment").alias("cigar"), F.when(left, "L").otherwise("R").alias("side"))
    two = F.struct(flag(mate_minus, minus, ~left).alias("flag"), (F.col("MateOffsetInReference").cast("int") + 1).alias("pos"), F.col("MateReferenceAlignment").alias("cigar"), F.when(left, "R").otherwise("L").alias("side"))
    out = evidence.select(read_name(evidence).alias("qname"), F.col("Chromosome").alias("rname"), q.alias("mapq"), F.explode(F.array(one, two)).alias("r"))
    return out.select("qname", "r.flag", "rname", "r.pos", "mapq", "r.cigar", "r.side")


def split_overlaps(reads: DataFrame) -> DataFrame:
    """rec_idx, cigar, seq, qual, gc, gs, gq: `B` elements (the read steps back) resolved.

    The bases read twice are merged, the one with the better score kept, on a tie the later one; gc tells the lengths of single and double
    stretches (S and G), gs and gq the bases and scores that were read twice. What a step does depends on all before it, so reads are
    walked in Arrow batches.
    """

    def walk(batches):
        for pdf in batches:
            out = [resolve(c, s, q) for c, s, q in zip(pdf["cigar"], pdf["seq"], pdf["qual"], strict=True)]
            yield pd.DataFrame({"rec_idx": pdf["rec_idx"], **{k: [o[i] for o in out] for i, k in enumerate(("cigar", "seq", "qual", "gc", "gs", "gq"))}})

    return reads.select("rec_idx", "cigar", "seq", "qual").mapInPandas(walk, "rec_idx long, cigar string, seq string, qual string, gc string, gs string, gq string")


def resolve(cigar: str, seq: str, qual: str) -> tuple[str, str, str, str, str, str]:
    """One read; see split_overlaps().

    After a step back the letters that were read twice are passed over: elements within that stretch vanish, pads and deletions
    among them, skips stay. Elements that take no part in evidence (clips) are passed over. A step back further than the
    read has come, or than it goes on, is an error.
    """
    ops: list[list] = []
    bases, scores, gc, gs, gq = [], [], [], [], []
    at = again = 0
    for count, op in re.findall(r"(\d+)([MIDNSHP=XB])", cigar):
        n = int(count)
        if op == "B":
            if not gc or n > len(bases) or at < n or at + n > len(seq):
                raise ValueError(f"a step back without letters to repeat: {cigar}")
            for i in range(at - n, at):
                # held against the letters as they were read, also where these were merged before
                later = qual[i + n] >= qual[i]
                k = len(bases) - at + i
                bases[k], scores[k] = (seq[i + n], qual[i + n]) if later else (bases[k], scores[k])
            gs.append(seq[at - n : at + n])
            gq.append(qual[at - n : at + n])
            gc[-1][0] -= n
            gc.append([n, "G"])
            again = n
        elif op in "M=XI":
            passed = min(again, n)
            again, at, n = again - passed, at + passed, n - passed
            if n or not passed:
                gc.append([n, "S"])
                bases += seq[at : at + n]
                scores += qual[at : at + n]
                at += n
                _append(ops, n, op)
        elif op == "N" or (op in "PD" and not again):
            _append(ops, n, op)
    return pack(ops), "".join(bases), "".join(scores), "".join(f"{n}{k}" for n, k in gc), "".join(gs), "".join(gq)


def _append(ops: list[list], n: int, op: str) -> None:
    """An element at the end; none of length 0, and one with the kind of the last is added to it."""
    if n and ops and ops[-1][1] == op:
        ops[-1][0] += n
    elif n:
        ops.append([n, op])


#: Kinds that cancel each other: what only the read has, and what only the contig has.
_SIDE = {"I": 1, "P": 1, "D": 2}


def pack(ops) -> str:
    """CIGAR text in which a neighbouring insertion (or pad) and deletion cancel: the shorter becomes matches (a skip, between pad and deletion), the longer keeps its kind and the rest of its length.

    Elements are put in one by one. Where two cancel in full, the later remains as the matches. Otherwise what came first of the two
    joins the element before it if that is of its kind, else the two change places, and the one now in front is
    tried against the element before it; the first two elements of all stay as they are.
    """
    out: list[list] = []
    for n, op in ops:
        _append(out, n, op)
        i = len(out) - 1
        while i > 0 and _SIDE.get(out[i][1], 0) + _SIDE.get(out[i - 1][1], 0) == 3:
            (m, first), (n_last, last) = out[i - 1], out[i]
            both, kind = min(m, n_last), "M" if "I" in (first, last) else "N"
            if m == n_last:
                out[i - 1 : i + 1] = [[both, kind]]
                break
            front, back = ([m, kind], [n_last - both, last]) if m < n_last else ([m - both, first], [both, kind])
            if i == 1:
                out[0:2] = [front, back]
                break
            if out[i - 2][1] == front[1]:
                out[i - 2][0] += front[0]
                out[i - 1 : i + 1] = [back]
            else:
                out[i - 1 : i + 1] = [back, front]
            i -= 1
    return "".join(f"{n}{op}" for n, op in out)
