"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Every text is encoded whole; documents are then aggregated by encoded length. For each
length L that occurs, taken as a context limit, the histogram's running sums tell how
many documents are longer, all tokens, what is kept if texts are cut at L, and the
share of documents of at most L tokens (so every quantile is the first row that
reaches it). Limits between two lengths follow from their neighbours (``at_limits``).

Byte-level BPE encodes each piece of the tokenizer's own split pattern alone, so a
worker keeps the lengths of pieces it has met and only splits the text again; the
result equals encoding the whole text.

Cases: null and empty texts have length 0; the strings of special tokens are ordinary
text; very long texts are encoded whole; repeated rows count each; an empty table gives
an empty histogram; other columns are ignored.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import scan, written

#: Folder and file of the vocabulary (ranks of a byte-level BPE).
FOLDER = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose lengths a worker remembers, and the characters of the longest of them.
REMEMBERED, LONGEST = 400_000, 64


class Encoder:
    """Encoded lengths of texts under a vocabulary file."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def length(self, text: str) -> int:
        pieces = self.pieces(text)
        known = self.known
        try:
            return sum(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        total = 0
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = len(self.encoding.encode_ordinary(p))
                if len(p) <= LONGEST:
                    known[p] = n
            total += n
        return total


_built: dict[str, Encoder] = {}


def encoded_lengths(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs: the kept columns and n_tokens."""
    path = path or f"{FOLDER}/{VOCABULARY}"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if path not in _built:
            _built[path] = Encoder(path)
        length = _built[path].length
        n = pa.array([length(t) if t else 0 for t in batch.column("text").to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), n], names=[*keep, "n_tokens"])

    kept = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return scan(docs, run, f"{kept}n_tokens long", *dict.fromkeys((*keep, "text")))


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, docs, docs_longer, tokens_at_most, tokens_total, truncated_total, share_at_most.

    Sums run within ranges of 1,024 lengths, then over the ranges' totals, so that no
    task holds more than one range or the list of ranges. The counts are written first, so
    that texts are encoded once.
    """
    counts = written(lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))).withColumn("range", F.floor(F.col("n_tokens") / 1024))
    ranges = counts.groupBy("range").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranges = ranges.select("range", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("tokens_total"))
    inside = Window.partitionBy("range").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"d": F.sum("docs").over(inside), "t": F.sum(F.col("docs") * F.col("n_tokens")).over(inside)}).join(ranges, "range")
    at_most, longer = F.col("d0") + F.col("d"), F.col("all_docs") - F.col("d0") - F.col("d")
    kept = F.col("t0") + F.col("t")
    return placed.select("n_tokens", "docs", longer.alias("docs_longer"), kept.alias("tokens_at_most"), "tokens_total", (kept + longer * F.col("n_tokens")).alias("truncated_total"), (at_most / F.col("all_docs")).alias("share_at_most"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit: docs_longer and truncated_total, from the histogram alone."""
    asked = hist.sparkSession.createDataFrame([(x,) for x in limits], "context_limit long")
    both = hist.crossJoin(F.broadcast(asked))  # the stated limits against the histogram's rows
    cut = F.least("n_tokens", "context_limit") * F.col("docs")
    return both.groupBy("context_limit").agg(F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("docs")).otherwise(0)).alias("docs_longer"), F.sum(cut).alias("truncated_total"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """Per share: the smallest length that so many documents do not exceed."""
    asked = hist.sparkSession.createDataFrame([(x,) for x in shares], "share double")
    both = hist.crossJoin(F.broadcast(asked)).where(F.col("share_at_most") >= F.col("share"))
    return both.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
