"""Benchmark decontamination: an Aho-Corasick automaton over normalised items.

Texts are normalised to words of digits, a-z and non-ASCII characters (A-Z lowered, the
rest of ASCII separates). Every run of WINDOW words of an item, or the whole item if it
is shorter, is a pattern. Words are numbered as they occur in the patterns, and each
number is written with DIGITS letters of BASE kinds (kinds of their own for each place, so
that matches begin and end with words), which keeps nodes few and narrow; the automaton
reads each normalised document once. Matches give word numbers, and these the byte offsets
of the original text in ``spans``, and the numbers of the patterns. Which items a pattern
belongs to stays in a table, however many they are: it is joined to the distinct sets of
patterns that documents hit, and a set's items run through their hash in order.

An automaton holds the patterns of at most NODES letters. A larger benchmark is dealt by
hash over as many automata as it needs; documents are scanned once for each, one broadcast
after the other, and what they hit is merged by row: the same rows and spans.

Cases: null and empty texts have no words, no hits; an item without words has no
window; a null item_id is skipped in the item list but its windows still hit; repeated
items each count; repeated documents return repeated rows; an empty benchmark leaves
every document clean; a very long text is read whole by one task, at some 100 bytes a
word; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import fresh, scan, texts, without_clash, written

WINDOW = 10
OUTPUT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
#: Letters of the patterns that one automaton holds, as nodes some 80 bytes each in a worker.
NODES = 2_500_000
#: Letters of a word's number; BASE ** DIGITS is above NODES / DIGITS.
BASE, DIGITS = 128, 3
UNKNOWN = "\0" * DIGITS

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
RUN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
HITS = "runs array<struct<first:long,last:long,start:long,end:long>>, hits array<long>"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_SPACED).split()


def windows(text: bytes, window: int = WINDOW) -> list[bytes]:
    found = normal_words(text)
    if len(found) <= window:
        return [b" ".join(found)] if found else []
    return [b" ".join(found[i : i + window]) for i in range(len(found) - window + 1)]


def code(number: int) -> str:
    return "".join(chr(BASE * (place + 1) + number // BASE**place % BASE) for place in reversed(range(DIGITS)))


class Matcher:
    """The automaton over (pattern, number) rows; a pattern is words with blanks between."""

    def __init__(self, patterns: Iterable[tuple[bytes, int]]):
        self.automaton = ahocorasick.Automaton()
        self.codes: dict[bytes, str] = {}
        for pattern, number in patterns:
            found = pattern.split()
            for w in found:
                if w not in self.codes:
                    self.codes[w] = code(len(self.codes))
            self.automaton.add_word("".join(map(self.codes.__getitem__, found)), (len(found), number))
        if self.codes:
            self.automaton.make_automaton()

    def match(self, found: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Numbers of hit words, numbers of the patterns that occur."""
        known: set[int] = set()
        hits = list(self.automaton.iter("".join(map(self.codes.get, found, repeat(UNKNOWN))))) if self.codes and found else []
        if not hits:
            return np.zeros(0, np.int64), known
        delta = np.zeros(len(found) + 1, np.int64)
        for end, (n, number) in hits:
            last = end // DIGITS
            delta[last - n + 1] += 1
            delta[last + 1] -= 1
            known.add(number)
        return np.flatnonzero(np.cumsum(delta[:-1])), known


_built: dict[str, Matcher] = {}


def _matcher(patterns: list[tuple[bytes, int]], key: str) -> Matcher:
    """Built once in a worker process, which holds one at a time."""
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(patterns)
    return _built[key]


def patterns(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(pattern, item): every window of every item, ids as strings."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, found = batch.column("item").to_pylist(), [windows(t, window) for t in texts(batch)]
        rows = [(w, i) for i, ws in zip(ids, found) for w in ws]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([i for _, i in rows], pa.string())], names=["pattern", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return scan(items, run, "pattern binary, item string", "item", "text")


def _scanned(docs: DataFrame, held: DataFrame, keep: tuple[str, ...], every: bool) -> DataFrame:
    """The kept columns, n_words, runs of hit words and pattern numbers; every row, or those
    with hits."""
    sent = docs.sparkSession.sparkContext.broadcast([(bytes(r.pattern), r.number) for r in held.collect()])  # at most NODES letters
    key = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        matcher = _matcher(sent.value, key)
        n_words, runs, hits = [], [], []
        for text in texts(batch):
            found = normal_words(text)
            hit, known = matcher.match(found)
            n_words.append(len(found))
            hits.append(sorted(known))
            own = []
            if len(hit):
                at = [m.span() for m in _WORD.finditer(text)]
                for part in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
                    own.append({"first": part[0], "last": part[-1], "start": at[part[0]][0], "end": at[part[-1]][1]})
            runs.append(own)
        arrays = [*(batch.column(k) for k in keep), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(hits, pa.list_(pa.int64()))]
        out = pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_words", "runs", "hits"])
        return out if every else out.filter(pa.array([bool(r) for r in runs], pa.bool_()))

    kept = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return scan(docs, run, f"{kept}, n_words long, {HITS}", *dict.fromkeys((*keep, "text")))


def _merged(hits: DataFrame, row: str) -> DataFrame:
    """One row a document: runs that meet or overlap become one, patterns once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column("runs").to_pylist():
                own: list[dict] = []
                for r in sorted(found, key=lambda r: (r["first"], r["last"])):
                    if own and r["first"] <= own[-1]["last"] + 1:
                        if r["last"] > own[-1]["last"]:
                            own[-1] |= {"last": r["last"], "end": r["end"]}
                    else:
                        own.append(r)
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(row), pa.array(out, pa.list_(RUN)), batch.column("hits")], names=[row, "runs", "hits"])

    met = hits.groupBy(row).agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    return met.mapInArrow(run, f"{row} long, {HITS}")


def _found(docs: DataFrame, known: DataFrame, keep: tuple[str, ...], window: int, nodes: int) -> DataFrame:
    """The kept columns, n_words, runs and hits of every row. known: pattern, number."""
    automata = math.ceil(known.count() * window * DIGITS / nodes)
    part = lambda i: known.where(F.pmod(F.xxhash64("pattern"), F.lit(max(1, automata))) == i)
    if automata <= 1:
        return _scanned(docs, part(0), keep, every=True)
    row = fresh(docs, "_row")[0]
    keyed = written(docs.select(*dict.fromkeys((*keep, "text"))).withColumn(row, F.monotonically_increasing_id()))
    first = written(_scanned(keyed, part(0), (*keep, row), every=True))
    more = [written(_scanned(keyed, part(i), (row,), every=False)) for i in range(1, automata)]
    hits = reduce(DataFrame.unionByName, (x.select(row, "runs", "hits") for x in (first.where(F.size("runs") > 0), *more)))
    found = first.drop("runs", "hits").join(_merged(hits, row), row, "left")
    return found.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in (x.split(" ", 1) for x in HITS.split(", "))}).drop(row)


def _numbered(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The patterns (pattern, number), and all windows (pattern, item)."""
    each = written(patterns(benchmark, window))
    return written(each.select("pattern").distinct().withColumn("number", F.monotonically_increasing_id())), each


def _items(sets: DataFrame, owners: DataFrame) -> DataFrame:
    """key, n_items, items_sha256 of sets (key, hits) of patterns. owners: number, item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, item, count, digest = None, None, 0, None
        for batch in batches:
            done = []
            for key, name in zip(batch.column("key").to_pylist(), batch.column("item").to_pylist(), strict=True):
                if key != last:
                    if last is not None:
                        done.append((last, count, digest.hexdigest()))
                    last, count, digest = key, 1, hashlib.sha256(name.encode())
                elif name != item:
                    count += 1
                    digest.update(b"," + name.encode())
                item = name
            yield _rows(done)
        yield _rows([] if last is None else [(last, count, digest.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "n_items", "items_sha256"])

    each = sets.select("key", F.explode("hits").alias("number")).join(owners, "number").select("key", "item")
    return each.repartition("key").sortWithinPartitions("key", "item").mapInArrow(run, "key string, n_items long, items_sha256 string")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), nodes: int = NODES) -> DataFrame:
    """Per row of docs: the kept columns, n_words, n_hit, n_items, items_sha256,
    contaminated, and hit ``spans`` as byte offsets [start, end) of the original text."""
    known, each = _numbered(benchmark, window)
    found = written(_found(docs, known, keep, window, nodes))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    spans = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    hit = F.size("runs") > 0
    keyed = found.where(hit).withColumn("key", F.sha2(F.array_join("hits", ","), 256))
    owners = each.where("item IS NOT NULL").join(known, "pattern").select("number", "item")
    items = _items(keyed.select("key", "hits").dropDuplicates(["key"]), owners)
    nothing = {"n_items": F.lit(None).cast("long"), "items_sha256": F.lit(None).cast("string")}
    whole = found.where(~hit).withColumns(nothing).unionByName(keyed.join(items, "key", "left").drop("key"))
    return whole.select(*keep, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), hit.alias("contaminated"), spans.alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, nodes: int = NODES) -> DataFrame:
    """The documents without a hit word, with the columns of docs."""
    own = without_clash(docs, (*OUTPUT, "runs", "hits", "key"))
    keep = tuple(own.columns)
    found = _found(own, _numbered(benchmark, window)[0], keep, window, nodes)
    return found.where(F.size("runs") == 0).select(*keep).toDF(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT *, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i)
  WHERE len(w) > 0),
g AS (
  SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT n FROM p) s, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)),
h AS (SELECT k, i, g.n, item_id FROM g JOIN p ON g.n = p.n AND g.gram = p.gram),
hit AS (SELECT DISTINCT k, j FROM h, unnest(range(i, i + n)) AS t(j)),
words AS (SELECT k, count(*) AS n_hit FROM hit GROUP BY k),
runs AS (SELECT k, min(j) AS a, max(j) AS b FROM (SELECT k, j, j - row_number() OVER (PARTITION BY k ORDER BY j) AS run FROM hit) GROUP BY k, run),
spans AS (
  SELECT k, string_agg(
      CAST(coalesce(list_sum(list_transform(gaps[1:a], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(w[1:a - 1], lambda x: strlen(x))), 0) AS BIGINT) || '-' ||
      CAST(coalesce(list_sum(list_transform(gaps[1:b], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(w[1:b], lambda x: strlen(x))), 0) AS BIGINT), ',' ORDER BY a) AS spans
  FROM runs JOIN (SELECT k, w, string_split_regex(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS gaps FROM d WHERE k IN (SELECT k FROM words)) USING (k) GROUP BY k),
items AS (
  SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k) LEFT JOIN spans USING (k)
"""
