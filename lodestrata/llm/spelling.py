"""Spelling variants: the frequent words one code point apart, and what each is a variant of.

All words are paths in a trie, and read backwards in a second one. Both are numbered: words
are dealt in ranges and sorted, a task walks its range and numbers the nodes that the word
before did not have. A node that several ranges share lies on the path of a word that parts
them; those paths are numbered ahead and known to all tasks, so numbers tell nodes apart
exactly. A word with one position left out is then a pair of integers (node of what stands
before, node of what stands after), and so is a place between two positions. Words that
meet in a pair with a position left out in both differ by a replacement; a word with a
position left out meets the word it becomes at that place. Of equal neighbouring letters
only the first is left out for that, so that every pair of words meets once.

What meets in a pair of nodes is bounded by the alphabet (the letters that fit the
position, 90 at most), so no pair is hot and counts and the best partner are read from the
group without writing its pairs.

Cases: null texts have no words, a null doc_id counts as empty text; runs and words may be
of any length, as a word takes time and space in proportion to it; ties between partners
go to the smaller word; repeated rows count again; an empty table has no words; other
columns do not matter.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import bounded_batches, texts, written
from lodestrata.llm.prefix_trie import crc32_sql

#: Fixed values of the contract: the runs, one in how many (by hash) loses a code point, the
#: least length and count of a word, how many times as frequent a form is.
RUNS = "[A-Za-zÀ-ÿ]+"
SLIP, LEAST_LENGTH, LEAST_COUNT, TIMES = 199, 6, 5, 5

#: A task's counts are handed on at so many words, or after so many bytes of text.
COUNTED_WORDS, COUNTED_BYTES = 100_000, 64 << 20
#: Words of a range; words sampled for each to part them; code points of a parting word.
RANGE_WORDS, SAMPLED, PARTING = 200_000, 16, 32


def _slipped(counts: Counter, doc: str, found: Counter) -> None:
    seed = zlib.crc32(f"{doc}:".encode())
    for word, k in found.items():
        h = zlib.crc32(word.encode(), seed)
        if h % SLIP == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= LEAST_LENGTH:
            counts[word] += k


def vocabulary(documents: DataFrame) -> DataFrame:
    """word, n: of at least LEAST_LENGTH code points and LEAST_COUNT occurrences."""
    runs = re.compile(RUNS)
    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, read = Counter(), 0
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), texts(batch), strict=True):
                _slipped(counts, doc, Counter(runs.findall(text.lower().decode("utf-8", "replace"))))
                read += len(text)
                if len(counts) >= COUNTED_WORDS or read >= COUNTED_BYTES:
                    yield _counted(counts)
                    read = 0
        yield _counted(counts)

    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc")
    counted = documents.select(doc, F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _counted(counts: Counter) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
    counts.clear()
    return batch


def _partings(words: DataFrame, key: Column, ranges: int) -> list[str]:
    """Strings that part the words into about so many even ranges. They follow from the
    words alone; where they lie moves work between tasks, never a result."""
    if ranges < 2:
        return []
    sample = sorted(r[0] for r in words.select(F.substring(key, 1, PARTING), F.xxhash64("word").alias("h")).orderBy("h").limit(SAMPLED * ranges).collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)})


def numbered(words: DataFrame, backwards: bool, ranges: int) -> DataFrame:
    """word, n and: id, ordered as the words are; nodes, the numbers of the paths' nodes from
    the root on; fresh, whether a code point differs from the one before it."""
    key = F.reverse("word") if backwards else F.col("word")
    partings = _partings(words, key, ranges)
    shared = {}
    for p in partings:
        for i in range(1, len(p) + 1):
            shared.setdefault(p[:i], -1 - len(shared))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [bisect.bisect_right(partings, k) for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "part"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before, path, made, index = -1, "", [0], 0, 0
        for batch in batches:
            ids, nodes, fresh = [], [], []
            for number, word in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if number != last:
                    last, before, path, made, index = number, "", [0], 0, 0
                same = 0
                for a, b in zip(before, word, strict=False):
                    if a != b:
                        break
                    same += 1
                del path[same + 1 :]
                for i in range(same + 1, len(word) + 1):
                    known = shared.get(word[:i]) if i <= PARTING else None
                    if known is None:
                        made += 1
                        known = (number << 40) + made
                    path.append(known)
                before, index = word, index + 1
                ids.append((number << 40) + index)
                nodes.append(list(path))
                fresh.append([True, *(a != b for a, b in zip(word, word[1:], strict=False))])
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ids, pa.int64()), pa.array(nodes, pa.list_(pa.int64())), pa.array(fresh, pa.list_(pa.bool_()))], names=["word", "n", "id", "nodes", "fresh"])

    kept = "word string, n long"
    dealt = words.select("word", "n", key.alias("key")).mapInArrow(part, f"{kept}, key string, part long")
    dealt = dealt.repartition("part").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(walk, f"{kept}, id long, nodes array<bigint>, fresh array<boolean>")


def _near(words: DataFrame) -> DataFrame:
    """words: id, n, ahead, behind, fresh. id, n_near, best (less, id): less is -n."""
    places = """concat(
      transform(sequence(0, size(fresh)), i -> named_struct('p', ahead[i], 's', behind[size(fresh) - i], 'out', false, 'first', false)),
      transform(sequence(0, size(fresh) - 1), i -> named_struct('p', ahead[i], 's', behind[size(fresh) - i - 1], 'out', true, 'first', fresh[i])))"""
    pairs = words.select("id", "n", F.inline(F.expr(places)))
    met = pairs.groupBy("p", "s").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "id", "out", "first"))).alias("all")).where("size(all) > 1")
    met = met.select("all", F.filter("all", lambda x: x["out"]).alias("outs"), F.get(F.filter("all", lambda x: ~x["out"]), F.lit(0)).alias("whole"))
    met = met.withColumn("firsts", F.filter("outs", lambda x: x["first"]))
    told = met.select(F.inline(F.expr("""transform(all, x -> named_struct('id', x.id,
      'near', if(x.out, size(outs) - 1 + if(x.first and whole is not null, 1, 0), size(firsts)),
      'best', array_min(transform(filter(if(x.out, array(if(get(outs, 0).id = x.id, get(outs, 1), get(outs, 0)), if(x.first, whole, null)), array(get(firsts, 0))), y -> y is not null), y -> struct(y.less as less, y.id as id)))))""")))
    return told.where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """forms: id, to. The last of each id's forms, found by doubling the steps: counts grow
    TIMES with every form, so chains are short and have an end."""
    while True:
        more = forms.select(F.col("id").alias("to"), F.col("to").alias("next"))
        forms = written(forms.select("id", "to").join(more, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if forms.where("moved").isEmpty():
            return forms.select("id", F.col("to").alias("root"))


def variants(documents: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    counts = written(vocabulary(documents))
    ranges = -(-counts.count() // range_words)
    ahead = numbered(counts, False, ranges).withColumnRenamed("nodes", "ahead")
    behind = numbered(counts, True, ranges).select("word", F.col("nodes").alias("behind"))
    words = written(ahead.join(behind, "word"))
    near = _near(words.select("id", "n", "ahead", "behind", "fresh"))
    words = words.select("id", "word", "n")
    likely = F.col("best.less") <= -TIMES * F.col("n")
    known = words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likely, F.col("best.id")).alias("to"), F.when(likely, -F.col("best.less")).alias("form_n"))
    known = written(known)
    named = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    forms = known.where("to IS NOT NULL").select("id", "to")
    found = forms.join(_roots(forms), "id").join(named("to"), "to").join(named("root"), "root").select("id", F.col("to_word").alias("form"), F.col("root_word").alias("root"))
    return known.join(found, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BYTES = "flatten(list_transform(string_split(doc || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END))"

SQL = f"""
WITH RECURSIVE r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{_UPPER}', '{_UPPER.lower()}') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc, w, count(*) AS k FROM r GROUP BY ALL),
h AS (SELECT *, {crc32_sql(_BYTES)} AS h FROM d),
v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {SLIP} = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, k FROM h)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
o AS (SELECT word, i, left(word, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, unnest(range(0, length(word))) AS i FROM v)),
near AS (
  SELECT x.word, y.word AS other FROM o x JOIN o y ON x.a = y.a AND x.b = y.b AND x.word <> y.word AND length(x.word) = length(y.word)
  UNION SELECT x.word, v.word FROM o x JOIN v ON v.word = x.a || x.b
  UNION SELECT v.word, x.word FROM o x JOIN v ON v.word = x.a || x.b),
best AS (
  SELECT near.word, v.word AS other, v.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, encode(v.word)) AS place
  FROM near JOIN v ON v.word = near.other),
f AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= {TIMES} * v.n THEN b.other END AS form, CASE WHEN b.other_n >= {TIMES} * v.n THEN b.other_n END AS form_n FROM v LEFT JOIN best b ON b.word = v.word AND b.place = 1),
up AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, up.root FROM f JOIN up ON f.form = up.word)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word
"""
