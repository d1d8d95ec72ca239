import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import lblm as L


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_base_and_counts_and_both_paths(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0
    c = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r.doc_id), held(r.doc_id), len(t := tokens(r.text)), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for r in rows)
    scores = []
    for limit in (L.LOCAL, 20, 0):
        got = L.held_out_scores(documents, limit).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        scores.append(sorted((str(r.doc_id), round(r.score, 4)) for r in got))
    assert scores[0] == scores[1] == scores[2]


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    counts = L.Counts.over([(b"ab", 3), (b"xy", 2)], 1, 10, 5)
    for w, k in ((b"cb", 1), (b"qb", 3)):
        counts.bin_tokens[counts.bin_of(w)] += k
        counts.bin_words[counts.bin_of(w)] += 1
    net = L.Network(counts.unigram())
    net.member += rng.standard_normal(net.member.shape).astype(np.float32)
    before = np.repeat(rng.integers(0, L.SYMBOLS, (L.ORDER, 3)), L.SYMBOLS, axis=1)
    p = 10 ** net.log10(before, np.tile(np.arange(L.SYMBOLS), 3))
    assert p.reshape(3, -1).sum(1) == pytest.approx([1, 1, 1], abs=1e-4)
    b = counts.bin_of(b"cb")
    inside = [1, 0] if counts.bin_of(b"qb") != b else [1, 3, 0]
    assert sum((k + L.SMOOTH) / 10 ** counts.inner_norm(np.array([b]))[0] for k in inside) == pytest.approx(1.0)


def test_noise_contrastive_learning_raises_likelihood():
    rng = np.random.default_rng(1)
    y = np.tile(np.arange(20) * 7, 600)
    before = np.stack([np.roll(y, o) for o in range(1, L.ORDER + 1)])
    unigram = (np.bincount(y, minlength=L.SYMBOLS) + 0.1) / (len(y) + 0.1 * L.SYMBOLS)
    net = L.Network(unigram)
    start = net.log10(before, y).mean()
    squares = [np.zeros_like(p) for p in net.parts()]
    for _ in range(40):
        at = rng.integers(0, len(y), 2000)
        net.learn(before[:, at], y[at], rng, squares)
    assert net.log10(before, y).mean() > start + 0.3


def test_beats_the_base_on_held_out_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    s = L.held_out_scores(docs).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.max("score")).first()
    assert s[1] > s[0] and s[2] <= 0


def test_empty_table(spark, empty, documents):
    assert L.held_out_scores(empty).count() == 0
    only = documents.where("doc_id IS NULL AND text IS NULL")
    assert L.held_out_scores(only).count() == 0


def test_every_training_document_trains(spark):
    """Each document alone moves the network from its start."""
    for k in range(3):
        model = L.fit(spark.createDataFrame([(k, f"word{k} and more " * 20)], "doc_id long, text string"))
        assert not np.array_equal(model.network.flat(), L.Network(model.counts.unigram()).flat())


def test_partitions_do_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = []
    for dealt in (docs, docs.repartition(7), docs.orderBy(F.desc("doc_id")).coalesce(2)):
        rows.append({r.doc_id: (r.base_score, r.score) for r in L.held_out_scores(dealt).collect()})
    for other in rows[1:]:
        assert other.keys() == rows[0].keys()
        for k, (b, s) in other.items():
            assert rows[0][k] == pytest.approx((b, s), rel=1e-6, abs=1e-6)


def test_names_that_clash(spark, documents):
    """Kept columns of any name pass through, next to the columns added."""
    model = L.fit(documents.select("doc_id", "text"))
    named = documents.select("doc_id", "text", F.lit(5).alias("_row"), F.lit("x").alias("_symbols"), F.lit(2).alias("row_"))
    got = L.score(named, model, ("doc_id", "_row", "_symbols", "row_"))
    assert got.columns == ["doc_id", "_row", "_symbols", "row_", "n_tokens", "n_known", "base_score", "score"]
    assert {(r._row, r._symbols, r.row_) for r in got.collect()} == {(5, "x", 2)}


def best(*functions, times=7):
    """The least CPU seconds of each, run in turn."""
    took = [[] for _ in functions]
    for _ in range(times):
        for f, t in zip(functions, took):
            began = time.thread_time()
            f()
            t.append(time.thread_time() - began)
    return [min(t) for t in took]


def plain_step(net, before, y, rng, squares):
    """Network.learn as its formulas say: sums by sorting, noise group by group."""
    inner, g = net.of_member, y // L.MEMBERS
    order = np.argsort(g.astype(np.int16), kind="stable")
    before, y, g = before[:, order], y[order], g[order]
    ends = np.searchsorted(g, np.arange(L.GROUPS + 1))
    r = net.context[before]
    h = np.einsum("obw,ow->bw", r, net.weigh)
    d = [np.zeros_like(p) for p in net.parts()]

    def add(into, at, rows):
        order = np.argsort(at.astype(np.int16), kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        into[at[starts]] += np.add.reduceat(np.take(rows, order, axis=0), starts, axis=0)

    noise = np.log(L.NOISE * net.of_group).astype(np.float32)
    k = np.minimum(np.searchsorted(np.cumsum(net.of_group), rng.random(L.NOISE)), L.GROUPS - 1)
    pull = 1 / (1 + np.exp((h * net.group[g]).sum(axis=1) + net.group_bias[g] - noise[g]))
    push = -1 / (1 + np.exp(noise[k] - net.group_bias[k] - h @ net.group[k].T))
    dh = pull[:, None] * net.group[g] + push @ net.group[k]
    add(d[2], g, h * pull[:, None])
    d[3] += np.bincount(g, pull, L.GROUPS)
    np.add.at(d[2], k, push.T @ h)
    np.add.at(d[3], k, push.sum(axis=0))
    noise = np.log(L.INNER_NOISE * np.maximum(inner.ravel(), 1e-30)).astype(np.float32)
    pull = 1 / (1 + np.exp((h * net.member[y]).sum(axis=1) + net.member_bias[y] - noise[y]))
    dh += pull[:, None] * net.member[y]
    add(d[4], y, h * pull[:, None])
    d[5] += np.bincount(y, pull, L.SYMBOLS)
    up_to = np.cumsum(inner, axis=1)
    drawn = (up_to[:, None, :] < (rng.random((L.GROUPS, L.INNER_NOISE)) * up_to[:, -1:])[:, :, None]).sum(axis=2)
    for q in range(L.GROUPS):
        own, k = slice(ends[q], ends[q + 1]), np.minimum(drawn[q], L.MEMBERS - 1) + L.MEMBERS * q
        push = -1 / (1 + np.exp(noise[k] - net.member_bias[k] - h[own] @ net.member[k].T))
        dh[own] += push @ net.member[k]
        np.add.at(d[4], k, push.T @ h[own])
        np.add.at(d[5], k, push.sum(axis=0))
    d[1] += np.einsum("obw,bw->ow", r, dh)
    add(d[0], before.ravel(), (dh[None] * net.weigh[:, None, :]).reshape(-1, L.WIDTH))
    for p, x, q in zip(net.parts(), d, squares):
        x /= len(y)
        q += x * x
        p += L.RATE * x / (np.sqrt(q) + 1e-6)


def test_a_step_is_the_plain_one_for_less():
    rng = np.random.default_rng(2)
    y = np.minimum(rng.zipf(1.3, L.CHUNK) - 1, L.SYMBOLS - 1) * 37 % L.SYMBOLS
    before = np.stack([rng.permutation(y) for _ in range(L.ORDER)])
    unigram = (np.bincount(y, minlength=L.SYMBOLS) + 0.1) / (len(y) + 0.1 * L.SYMBOLS)
    nets = [L.Network(unigram) for _ in range(2)]
    for net in nets:
        net.member += np.random.default_rng(3).standard_normal(net.member.shape).astype(np.float32)
    draws, squares = [np.random.default_rng(4) for _ in nets], [[np.zeros_like(p) for p in net.parts()] for net in nets]
    few = slice(0, 50)  # groups without a token
    for at in (few, slice(None), few):
        nets[0].learn(before[:, at], y[at], draws[0], squares[0])
        plain_step(nets[1], before[:, at], y[at], draws[1], squares[1])
    for p, q in zip(nets[0].parts(), nets[1].parts()):
        assert np.abs(p - q).max() < 1e-3 and np.abs(p - q).mean() < 1e-5
    took, plain = best(lambda: nets[0].learn(before, y, draws[0], squares[0]), lambda: plain_step(nets[1], before, y, draws[1], squares[1]))
    assert took < 0.7 * plain


@pytest.mark.parametrize("scale", [1, 300])
def test_log_probabilities_are_the_plain_ones(scale):
    """Also where powers of the scores leave the range of a float."""
    rng = np.random.default_rng(5)
    net = L.Network(np.full(L.SYMBOLS, 1 / L.SYMBOLS))
    for p in (net.context, net.group, net.member):
        p[...] = rng.standard_normal(p.shape) * scale**0.5
    before, y = rng.integers(0, L.SYMBOLS, (L.ORDER, 9000)), rng.integers(0, L.SYMBOLS, 9000)
    h = np.einsum("obw,ow->bw", net.context[before], net.weigh).astype(float)

    def softmax(scores, picked):
        scores = scores - scores.max(axis=1, keepdims=True)
        return scores[np.arange(len(picked)), picked] - np.log(np.exp(scores).sum(axis=1))

    members, biases = net.member.reshape(L.GROUPS, L.MEMBERS, L.WIDTH), net.member_bias.reshape(L.GROUPS, L.MEMBERS)
    g = y // L.MEMBERS
    want = softmax(h @ net.group.T + net.group_bias, g) + softmax(np.einsum("bw,bmw->bm", h, members[g]) + biases[g], y % L.MEMBERS)
    assert net.log10(before, y) == pytest.approx(want / math.log(10), rel=1e-4, abs=1e-4)


def test_words_are_looked_up_once(monkeypatch):
    """Rows of words by their slots, also after forgetting; only words not held are dealt to bins."""
    monkeypatch.setattr(L, "REMEMBERED", 40)
    counts = L.Counts.over([(b"ab", 3), (b"xy", 2)], 5, 40, 9)
    h = np.array([L.xxhash.xxh3_64_intdigest(b"w7")], np.uint64)
    counts.hashes, counts.numbers = h, np.array([2])
    lookup, asked = L._Lookup(counts), []
    bins_of = L.Counts.bins_of
    monkeypatch.setattr(L.Counts, "bins_of", lambda self, words: asked.extend(words) or bins_of(self, words))
    for many in (5, 100, 8, 8):
        tokens = [b"ab", b"w7", L.END_WORD, *(b"w%d" % (i % many) for i in range(300)), b"xy"]
        asked.clear()
        slots, met = lookup.slots(tokens), asked.copy()
        symbols, known, base, inner, joined = (x[slots] for x in lookup.columns)
        assert len(met) == len(set(met))
        for i, w in enumerate(tokens):
            s, n = counts.frequent.get(w, (None, 2 if w == b"w7" else None))
            s = counts.bin_of(w) if s is None else s
            own = math.log10(n + L.SMOOTH) if n else 0
            assert (symbols[i], known[i], joined[i]) == (s, n is not None, n is None)
            assert base[i] == pytest.approx(own - counts.base_norm())
            assert inner[i] == pytest.approx(0 if w in counts.frequent else own - counts.inner_norm(np.array([s]))[0])
    assert not met  # the last round met only words that were held
