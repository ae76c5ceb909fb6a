"""Quality classifier by Bradley-Terry pairwise ranking.

Pairs of a good and a bad labelled document say which of the two is preferred; a linear score of
text features is learned by the logistic loss on the pairs' feature differences. The score is then
mapped to 0..1 so that the cut of 0.3 falls on the quantile of the training scores that equals the
share of bad labels, which makes predicted = score >= 0.3 a threshold by score quantile.

The model is fitted on the driver on a bounded sample: at most SAMPLE labelled rows (the lowest by
a hash of the id), of which ids with crc32 mod 5 = 0 are held out. Every document is scored.

Defined results: a null or empty text has features of its own and gets a score like any other;
repeated rows get equal rows; unlabelled rows and null labels teach nothing; a document labelled
both ways counts as both; without labels of both kinds every score is 0.5; a very long text is read whole, its
features are shares; documents that tie at the quantile have one score, all at the threshold or above it are 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import crc_mod, documents, id_type, map_rows
from readloom.llm.textstats import CLASSES, base_counts, class_counts

HELD_OUT_MOD = 5
#: Labelled rows that the model may learn from, pairs drawn from them, and the cut of the score.
SAMPLE, PAIRS, CUT = 6000, 12_000, 0.3
_LOW = bytes(range(97, 123))


def features(text: str | None) -> np.ndarray:
    """Shares and sizes of one text; nothing but the text enters."""
    text = text or ""
    n, chars, symbols, dup, rep = base_counts(text)
    b = text.encode()
    words = b.split()
    lines = b.count(b"\n") + 1
    classes = class_counts(text) / max(1, len(text)) if text else np.zeros(CLASSES)
    mean = chars / max(1, n)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    ends = sum(w[-1:] in (b".", b",", b"!", b"?", b";", b":") for w in words)
    marked = sum(not (w[-1:].isalnum() or w[-1] > 127) for w in words)
    same = sum(a == c for a, c in zip(words, words[1:], strict=False))
    return np.array([
        1.0 if not n else 0.0, np.log1p(n), 1.0 if n < 10 else 0.0, mean, lengths.std(), symbols / max(1, n), dup / lines, rep / max(1, n), float(100 * rep > 20 * n),
        ends / max(1, n), marked / max(1, n), same / max(1, n), len(set(words)) / max(1, n), (lengths <= 3).mean() if n else 0.0, (lengths == 1).mean() if n else 0.0,
        b.count(b"|") / max(1, n), b.count(b"!!") / max(1, n), n / lines / 20, *classes,
    ])


class BradleyTerry:
    """score(text) in 0..1; weights, mean and spread of the features, and the map to 0..1."""

    def __init__(self, x: np.ndarray, good: np.ndarray, steps: int = 350, penalty: float = 1e-3):
        self.ready = bool(len(x)) and 0 < good.sum() < len(good)
        if not self.ready:
            return
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        rng = np.random.default_rng(9)
        pos, neg = np.flatnonzero(good), np.flatnonzero(~good)
        d = z[rng.choice(pos, PAIRS)] - z[rng.choice(neg, PAIRS)]
        w, m, v = np.zeros(z.shape[1]), 0.0, 0.0
        for k in range(1, steps + 1):  # Adam on the whole set of pairs
            g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -40, 40))))[:, None]).mean(0) + penalty * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.w = w
        s = np.sort(z @ w)
        bad = int(round((~good).mean() * len(s)))
        bad = min(max(bad, 1), len(s) - 1)
        self.at = (s[bad - 1] + s[bad]) / 2  # the quantile that equals the share of bad labels
        self.scale = 1 / max(1e-6, np.std(d @ w) / 2)
        self.shift = float(np.log(CUT / (1 - CUT)))

    def score(self, x: np.ndarray) -> float:
        if not self.ready:
            return 0.5
        s = np.clip((x - self.mean) / self.spread, -6, 6) @ self.w
        return float(1 / (1 + np.exp(-np.clip(self.scale * (s - self.at) + self.shift, -40, 40))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> BradleyTerry:
    """Learn from the labelled rows that aren't held out."""
    of = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("good")).where("good in (0, 1) and label_id is not null")
    of = of.where(crc_mod(F.col("label_id"), HELD_OUT_MOD) != 0).distinct()
    of = of.orderBy(F.xxhash64("label_id"), "label_id", "good").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(of), F.col("doc_id") == F.col("label_id"))  # at most `sample` small rows
    n = len(features(""))
    known = map_rows(rows, ["doc_id", "text", "good"], "doc_id string, good int, x array<double>", lambda i, t, g: ([None if a is None else str(a) for a in i], g, [features(a).tolist() for a in t]))
    got = known.orderBy(F.xxhash64("doc_id"), "doc_id", "good", "x").limit(sample).collect()  # repeated ids can't make it more
    return BradleyTerry(np.array([r["x"] for r in got]).reshape(len(got), n), np.array([r["good"] == 1 for r in got], bool))


def score(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def run(ids, texts):
        s = [model.score(features(t)) for t in texts]
        return ids, s, [int(x >= CUT) for x in s]

    out = map_rows(docs, ["doc_id", F.col("text").cast("string")], f"doc_id {id_type(docs)}, score double, predicted int", run)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), HELD_OUT_MOD) == 0).alias("held_out"), "score", "predicted")


def op9_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model learned from the labels."""
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
