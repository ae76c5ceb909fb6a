"""Quality rules: base counts, then distribution divergence.

A document's histogram of character classes, and that of its language's common words, are compared
with the language's reference histograms by Jensen-Shannon distance (0 to 1). The references are
sums over all documents of the language that pass the base rules; they are learned in a pass of
their own. Guards: a histogram is only judged from so many characters or words on.

Defined results: a null or empty text has no words and fails the base rules; a null language is a
language of its own; documents of a language with few documents (MIN_DOCS) are judged by the base
rules alone, those of one without a list of common words by character classes; repeated rows get equal rows; a very long text is counted whole (repeated
windows by sorted integers, in memory in proportion to it); a distance equal to its limit passes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import cut, documents, freed, id_type, map_rows, sliced
from readloom.llm.textstats import CLASSES, base_counts, class_counts, plain_words

#: Very common words of some languages.
COMMON = {
    "en": "the of and to a in is was that it for on as with be at by this from or an are not have which but were his had they".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont la avec son aux d".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
    "it": "di e il la che in a per un del è con non i le una si da al dei nel come più della sono ha o anche lo gli".split(),
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou".split(),
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om ook als dan bij maar door uit naar of hij die nog over".split(),
}
_INDEX = {k: {w.encode(): i for i, w in enumerate(dict.fromkeys(v))} for k, v in COMMON.items()}
WORD_BINS = max(map(len, _INDEX.values())) + 1
BINS = CLASSES + WORD_BINS

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Guards: characters and words from which on a histogram is judged.
MIN_CHARS, MIN_COMMON_WORDS = 200, 60
MAX_CLASS_DISTANCE = 0.33
#: The distance of a sample of n words from its own source falls as 1 / sqrt(n); the limit follows it.
WORD_DISTANCE, WORD_NOISE = 0.12, 1.6
#: A language has a reference from so many documents on (the default of a parameter); with fewer its documents are judged by the base rules alone.
MIN_DOCS = 50
#: Up to so many references are broadcast.
BROADCAST_LANGS = 10_000


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def histograms(text: str, lang: str | None) -> np.ndarray:
    """Character-class counts, then counts of the language's common words, the last bin for all other words."""
    out = np.zeros(BINS, np.int64)
    out[:CLASSES] = class_counts(text)
    if (index := _INDEX.get(lang)) is not None:
        words = plain_words(text)
        found = [i for i in map(index.get, words) if i is not None]
        out[CLASSES:] = np.bincount(np.array(found, np.int64), minlength=WORD_BINS)
        out[-1] = len(words) - len(found)
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits between two histograms of counts; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    both = sum(float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum()) for x in (p, q))
    return float(np.sqrt(min(1.0, max(0.0, both / 2))))


def references(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, ref: the summed histogram of each language, over all its documents that pass the base rules, where these are min_docs at least. Written to the shared folder, so it is made once."""
    import pyarrow as pa

    def partial(batches):
        sums: dict = {}
        for batch in sliced(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = base_counts(text)
                if not base_failed(n[0], n[4]):
                    row = sums.setdefault(lang, np.zeros(BINS + 1, np.int64))
                    row[:-1] += histograms(text, lang)
                    row[-1] += 1
            if len(sums) > 10_000:
                yield from emit(sums)
                sums = {}
        yield from emit(sums)

    def emit(sums):
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([int(v[i]) for v in sums.values()], pa.int64()) for i in range(BINS + 1))], names=["lang", *names])

    names = [f"b{i}" for i in range(BINS + 1)]
    parts = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(freed(partial), "lang string, " + ", ".join(f"{n} long" for n in names))
    by_lang = parts.groupBy("lang").agg(*(F.sum(n).alias(n) for n in names))
    return cut(by_lang.where(F.col(names[-1]) >= min_docs).select("lang", F.array(*names[:-1]).alias("ref")))


def _with_reference(docs: DataFrame, min_docs: int) -> DataFrame:
    """doc (all columns of docs as a struct) and ref (null where the language has none). Up to BROADCAST_LANGS references, a few hundred bytes each, go to every task; more are joined by language, where the engine splits a language that is much larger than others."""
    refs = references(docs, min_docs).withColumnRenamed("lang", "ref_lang")
    if refs.count() <= BROADCAST_LANGS:
        refs = F.broadcast(refs)
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    return rows.join(refs, F.col("doc.lang").cast("string").eqNullSafe(F.col("ref_lang")), "left").select("doc", "ref")


def judge(text: str | None, lang: str | None, ref: list[int] | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance (null: too short to tell, or no reference)."""
    n = base_counts(text)
    h = histograms(text or "", lang)
    own = None if ref is None else np.asarray(ref, np.int64)
    far = js_distance(h[:CLASSES], own[:CLASSES]) if own is not None and h[:CLASSES].sum() >= MIN_CHARS else None
    words = js_distance(h[CLASSES:], own[CLASSES:]) if own is not None and h[CLASSES:].sum() >= MIN_COMMON_WORDS and own[CLASSES:].sum() else None
    failed = base_failed(n[0], n[4])
    limit = WORD_DISTANCE + WORD_NOISE / float(max(1, h[CLASSES:].sum())) ** 0.5
    return (*n, failed, not (failed or (far or 0) > MAX_CLASS_DISTANCE or (words or 0) > limit), far, words)


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def verdicts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id and the fields of judge(), for each row of docs."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def run(ids, texts, langs, refs):
        return [ids, *zip(*(judge(*x) for x in zip(texts, langs, refs, strict=True)), strict=True)]

    rows = _with_reference(slim, min_docs).select("doc.doc_id", "doc.text", "doc.lang", "ref")
    return map_rows(rows, ["doc_id", "text", "lang", "ref"], f"doc_id {id_type(docs)}, {VERDICT}", run)


def _good(batches, own: dict[str, bool]):
    """Of batches with doc and ref, and with text and lang where doc has them in another type, the documents that the rules keep."""
    import pyarrow as pa

    for batch in sliced(batches):
        doc = batch.column("doc")
        texts, langs = ((doc.field(c) if own[c] else batch.column(c)).to_pylist() for c in ("text", "lang"))
        good = pa.array([judge(*x)[6] for x in zip(texts, langs, batch.column("ref").to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([doc.filter(good)], names=["doc"])


def keep(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    own = {c: docs.schema[c].dataType.simpleString() == "string" for c in ("text", "lang")}  # these are sent once, within doc
    rows = _with_reference(docs, min_docs).select("doc", "ref", *(F.col(f"doc.{c}").cast("string").alias(c) for c in own if not own[c]))
    return rows.mapInArrow(freed(lambda batches: _good(batches, own)), rows.select("doc").schema).select("doc.*")


def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return verdicts(documents(spark, sf_dir))
