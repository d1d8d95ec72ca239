"""Quality rules: hashed n-gram log-likelihood ratio of trusted target and raw corpus.

Every text is read as UTF-8 bytes; each run of GRAM bytes is hashed into one of BUCKETS
bins. Two multinomials over the bins are counted, the raw one over all documents, the
target one over a bounded sample of labelled documents that are trusted (quality 1, not
toxic). A text's score is the mean log ratio target/raw of its n-grams. The threshold is
read off the scores of the labelled sample. A floor lies as far under the KEEP_SHARE
lower quantile of the trusted scores as their median lies over it; the threshold is half
way from there to the upper twentieth of the untrusted scores, or the floor itself if
that is lower or nothing untrusted is labelled. Every document is held against it alike.
The base rules reject first.

Cases: null and empty texts have no words and fail the base; a text of fewer than GRAM
bytes scores zero; without trusted labels nothing but the base rejects; labels that
contradict each other for a doc_id count as untrusted; null doc_ids are never in the
sample; very long texts are read whole; repeated rows return repeated rows; an empty
table returns no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import bounded_batches, texts, without_clash, written

GRAM = 3
BUCKETS = 1 << 14
#: Labelled documents that the target and the threshold are fitted on, per label.
SAMPLE = 20_000
#: Share of trusted labelled documents that must stay above the threshold.
KEEP_SHARE = 0.002
MIN_WORDS = 50
OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
SYMBOLS = b"#*$%&|<>"


def grams(text: bytes) -> np.ndarray:
    """Bins of the hashed byte n-grams."""
    x = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(x) < GRAM:
        return np.zeros(0, np.uint32)
    h = np.zeros(len(x) - GRAM + 1, np.uint32)
    for i in range(GRAM):
        h = h * np.uint32(257) + x[i : len(x) - GRAM + 1 + i]
    h *= np.uint32(2654435761)
    return h >> np.uint32(32 - 14)


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    found = text.split()
    chars = sum(map(len, found))
    if not text.isascii():
        x = np.frombuffer(text, np.uint8)
        chars -= int(np.count_nonzero((x & 0xC0) == 0x80))  # continuation bytes stand inside words
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.split()]
    repeat = 0
    if len(found) > 3:
        tri = list(zip(found, found[1:], found[2:]))
        if len(set(tri)) < len(tri):
            times = Counter(tri)
            upto = 0
            for i, t in enumerate(tri):
                if times[t] > 1:
                    repeat += i + 3 - max(i, upto)
                    upto = i + 3
    return len(found), chars, symbols, len(lines) - len(set(lines)), repeat


def base_fails(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > 50 * n_words


class Model:
    """weights: log ratio of each bin; threshold: scores below are rejected."""

    def __init__(self, weights: np.ndarray, threshold: float):
        self.weights, self.threshold = weights, threshold

    def score(self, text: bytes) -> float:
        g = grams(text)
        return float(self.weights[g].mean()) if len(g) else 0.0


def labelled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, good): trusted and untrusted documents, at most ``sample`` of each, by
    hash order (ties by doc_id)."""
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))

    def first(rows: DataFrame, good: bool) -> DataFrame:
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.lit(good).alias("good"))

    return written(first(one.where("q = 1 AND t = 0"), True).unionByName(first(one.where("q = 0"), False)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Count both multinomials over the documents, then set the threshold."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = F.broadcast(labelled(labels, sample))  # at most two rows a ``sample``
    rows = docs.select("doc_id", "text").join(known, "doc_id", "left").select("text", "good")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, good in zip(texts(batch), batch.column("good").to_pylist()):
                n = np.bincount(grams(text), minlength=BUCKETS)
                raw += n
                if good:
                    target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bin", "raw", "target"])

    bins = rows.mapInArrow(count, "bin int, raw long, target long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[bins["bin"]], target[bins["bin"]] = bins["raw"], bins["target"]
    if not target.sum():
        return Model(np.zeros(BUCKETS), -np.inf)
    q = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    p = (target + 0.5) / (target.sum() + 0.5 * BUCKETS)
    model = Model(np.log(p / q), -np.inf)
    weights = spark.sparkContext.broadcast(model.weights)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(weights.value, 0.0)
        for batch in batches:
            scores = [np.nan if base_fails((b := base_counts(t))[0], b[4]) else held.score(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(scores, pa.float64())], names=["good", "score"])

    rated = rows.where("good IS NOT NULL").mapInArrow(rate, "good boolean, score double").where(~F.isnan("score"))
    cuts = {r.good: r for r in rated.groupBy("good").agg(F.percentile("score", F.lit(KEEP_SHARE)).alias("low"), F.percentile("score", F.lit(0.5)).alias("mid"), F.percentile("score", F.lit(0.95)).alias("high")).collect()}
    if True in cuts:
        floor, high = 2 * cuts[True].low - cuts[True].mid, cuts[False].high if False in cuts else np.inf
        model.threshold = min(floor, (floor + high) / 2)
    return model


def judge(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the kept columns, the base counts, base_failed, score, kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            whole = texts(batch)
            counts = [base_counts(t) for t in whole]
            failed = [base_fails(c[0], c[4]) for c in counts]
            scores = [held.score(t) for t in whole]
            kept = [not f and s >= held.threshold for f, s in zip(failed, scores)]
            columns = list(zip(*counts)) or [()] * 5
            arrays = [*(batch.column(k) for k in keep), *(pa.array(c, pa.int64()) for c in columns), pa.array(failed, pa.bool_()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *OUTPUT])

    columns = list(dict.fromkeys((*keep, "text")))
    kept = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    schema = f"{kept}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return docs.select(*columns).mapInArrow(run, schema)


def rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return judge(docs, fit(docs, labels, sample))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that pass, with the columns of docs."""
    own = without_clash(docs, OUTPUT)
    return judge(own, fit(docs, labels, sample), keep=tuple(own.columns)).where("kept").select(*own.columns).toDF(*docs.columns)
