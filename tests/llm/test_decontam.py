import hashlib
import re

from pyspark.sql import functions as F

from lodestrata.llm import decontam as D

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    w = words(text)
    hit, ids = set(), set()
    for k, t in items:
        v = words(t)
        n = min(len(v), window)
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                ids.add(k)
    s = ",".join(sorted(str(k) for k in ids if k is not None))
    return len(w), len(hit), len([k for k in ids if k is not None]), hashlib.sha256(s.encode()).hexdigest(), bool(hit)


ITEMS = [(1, "The QUICK brown fox-jumps over the lazy dog, and then it sleeps until noon!"), (2, "short item"), (10, "café 中 naïve"), (3, ""), (4, None), (None, "nameless thing here"), (2, "short item")]
TEXTS = [(1, "x the quick BROWN fox jumps over the lazy dog and then it sleeps until noon y"), (2, "a short item; a short item"), (3, None), (4, ""), (5, "nothing at all"), (6, "Café 中 naïve short item"), (6, "Café 中 naïve short item"), (None, "a nameless thing here"), (7, "quick brown fox jumps over the lazy dog and then it"), (8, "pad " * 30000 + "short item")]


def test_against_brute_force_both_ways(spark, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(k, t, 7) for k, t in TEXTS], "doc_id long, text string, n_hit int")
    want = sorted(repr((k, *brute(t, ITEMS))) for k, t in TEXTS)
    spans = []
    for nodes in (D.NODES, 70, 20):  # one, two and several automata
        rows = D.contamination(docs, bench, nodes=nodes).collect()
        assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in rows) == want
        spans.append(sorted(repr((r.doc_id, r.spans)) for r in rows))
    assert spans[0] == spans[1] == spans[2]
    assert D.contamination(empty, bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, none).where("contaminated").count() == 0


def test_a_window_of_many_items_stays_in_its_table(spark):
    """One window shared by many items: what is broadcast and built does not grow with them."""
    shared = "one two three four five six seven eight nine ten"
    bench = spark.range(60_000).select(F.col("id").alias("item_id"), F.concat(F.lit(shared + " own"), (F.col("id") % 50).cast("string")).alias("text"))
    known, each = D._numbered(bench, 10)
    assert known.count() == 51 and each.count() == 120_000
    docs = spark.createDataFrame([(1, shared), (2, "x " + shared + " own7 y"), (3, shared + "!"), (4, "none")], "doc_id long, text string")
    rows = {r.doc_id: r for r in D.contamination(docs, bench).collect()}
    all_ids = hashlib.sha256(",".join(sorted(map(str, range(60_000)))).encode()).hexdigest()
    assert {(rows[i].n_items, rows[i].items_sha256) for i in (1, 2, 3)} == {(60_000, all_ids)}
    assert [rows[i].n_hit for i in (1, 2, 3, 4)] == [10, 11, 10, 0] and rows[4].n_items == 0


def test_spans_map_to_the_original(spark):
    text = "Intro: The QUICK brown fox-jumps over the lazy dog, and then end"
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    row = D.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).first()
    assert [text.encode()[s.start : s.end].decode() for s in row.spans] == ["The QUICK brown fox-jumps over the lazy dog, and then"]


def test_stage_drops_hits_and_keeps_columns(spark):
    docs = spark.createDataFrame([(k, t, 7) for k, t in TEXTS], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs.withColumn("w", docs.n_hit)
    for nodes in (D.NODES, 20):
        kept = D.drop_contaminated(docs, bench, nodes=nodes)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
        assert {(r.n_hit, r.w) for r in kept.collect()} == {(7, 7)}
