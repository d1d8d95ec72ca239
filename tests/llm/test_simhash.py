import random
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import simhash as S


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """prints: list of (id, fp). Smallest id reachable, by all pairs."""
    label = [k for k, _ in prints]
    while True:
        new = [min((label[j] for j, (_, q) in enumerate(prints) if (p ^ q).bit_count() <= 4 and label[j] is not None), default=None) for _, p in prints]
        if new == label:
            return label
        label = new


def test_any_four_positions_hold_a_set():
    for size, count in ((2, 7), (3, 20)):
        sets = S.position_sets(size)
        assert len(sets) == count
        assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 4))


def test_fingerprints_and_components(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    prints = [(r.doc_id, brute(r.text)) for r in rows]
    want = sorted((str(k), f"{fp:016x}", str(c)) for (k, fp), c in zip(prints, components(prints)))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in S.near_duplicates(documents).collect())
    assert got == want
    by_id = {r.doc_id: r.component_id for r in S.near_duplicates(documents).collect()}
    assert by_id[2] == 1 and by_id[3] == 1 and by_id[6] == 5 and by_id[7] == 5


def test_links_lose_nothing_in_blocks_and_triples(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = {c for c in centres}
    for c in centres:
        for _ in range(40):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    label = {v: v for v in values}
    for a, b in combinations(values, 2):
        if (a ^ b).bit_count() <= 4:
            x, y = label[a], label[b]
            if x != y:
                low, high = min(x, y), max(x, y)
                label = {k: low if v == high else v for k, v in label.items()}
    want = len({v for v in label.values()})
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)), i) for i, v in enumerate(values)], "fp long, doc_id long")
    for block, triples in ((1024, 1 << 26), (16, 1 << 26), (16, 1)):
        assert S.classes(df, block, triples).select("component_id").distinct().count() == want


def test_empty_table_and_keep_one(spark, documents, empty):
    assert S.near_duplicates(empty).count() == 0
    kept = S.keep_one(documents)
    assert kept.columns == documents.columns
    assert {r._k for r in kept.select("_k").collect()} == {"a"}
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert "2" not in ids and "3" not in ids and ids.count("11") == 1 and "1" in ids and "None" in ids
    assert S.keep_one(empty).count() == 0
    assert kept.where(F.col("doc_id") == 9).count() == 1


def test_many_near_fingerprints_in_bounded_memory():
    """A list of 2,048 fingerprints of which most pairs link is reduced as it is compared."""
    rng = np.random.default_rng(0)
    fp = np.unique(np.uint64(1 << 60) ^ (np.uint64(1) << rng.integers(0, 16, 4000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 16, 4000).astype(np.uint64)))
    fp = np.unique(np.concatenate([fp ^ np.uint64(k) for k in range(0, 4096, 16)]))[:2048]
    sets = S.position_sets(2)
    number = next(n for n, s in enumerate(sets) if s == (3, 4))
    rows = np.column_stack([np.full(len(fp), number * 65536), np.zeros(len(fp)), np.zeros(len(fp)), np.zeros(len(fp))]).astype(np.int64)
    within = np.column_stack([rows, fp.view(np.int64)])
    held = []
    add = S.Forest.add

    def watched(self, a, b):
        add(self, a, b)
        held.append(self.held)

    S.Forest.add = watched
    try:
        for limit in (S.PAIRS, 5000):
            S.PAIRS, old = limit, S.PAIRS
            a, b = S._forest(within, sets, 4)
            S.PAIRS = old
            assert len(a) < len(fp) and max(held) <= limit + len(fp)
            held.clear()
        two = within.copy()
        two[:, 2], two[:, 3] = 1, np.arange(len(fp)) % 2
        c, d = S._forest(two, sets, 4)
        of = {int(v): i % 2 for i, v in enumerate(fp)}
        assert len(c) and len(c) < len(fp) and set(map(int, c)) | set(map(int, d)) <= set(of)
    finally:
        S.Forest.add = add


def test_frequent_fingerprints_and_others(spark, documents, monkeypatch):
    monkeypatch.setattr(S, "FREQUENT", 7)  # three of the fifteen rows are empty
    rows = documents.select("doc_id", "text").collect()
    prints = [(r.doc_id, brute(r.text)) for r in rows]
    want = sorted((str(k), str(c)) for (k, _), c in zip(prints, components(prints)))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in S.near_duplicates(documents).collect()) == want
