import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import langid as L


def parse(text: str, corpus: str, lane: int) -> int:
    """Longest phrases that occur in corpus, lane by lane; unknown characters count alone."""
    n = 0
    for s in range(0, len(text), lane):
        part, i = text[s : s + lane], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in corpus:
                j += 1
            i = max(i + 1, j - 1)
            n += 1
    return n


def test_phrases_against_substring_search():
    rng = np.random.default_rng(0)
    train = {k: ["".join(rng.choice(list(a), 400))] for k, a in (("aa", "abcd "), ("bb", "cdefg "))}
    model = L.Languages(train)
    texts = ["".join(rng.choice(list("abcdefgz "), n)) for n in (1, 5, 700, 1300)] + [train["aa"][0][10:90]]
    folded = [L.fold(t) for t in texts]
    got = model.phrases(folded)
    for i, f in enumerate(folded):
        line = "".join(map(chr, f))
        want = [parse(line, "".join(map(chr, L.fold(train[k][0]))), L.LANE) for k in model.names]
        assert got[i].tolist() == want


def test_fold():
    assert "".join(map(chr, L.fold("Ab!! 1 É-c"))) == "ab é c"
    assert len(L.fold("123 ... !")) == 0 and len(L.fold("")) == 0


def test_odd_rows(spark, documents, empty):
    rows = L.held_out_predictions(documents).collect()
    assert len(rows) == documents.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].lang_pred == by_id[6].lang_pred == by_id[7].lang_pred == by_id[10].lang_pred == "und"
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert L.held_out_predictions(empty).count() == 0
    assert {r.lang_pred for r in L.identify(documents, {}).collect()} == {"und"}


def test_labels_of_held_out_rows_never_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    changed = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    a, b = (sorted((r.doc_id, r.lang_pred) for r in L.held_out_predictions(d).collect()) for d in (docs, changed))
    assert a == b


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    joined = L.held_out_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] == pytest.approx(1.0, abs=0.05)


def test_phrases_of_large_alphabets():
    rng = np.random.default_rng(1)
    signs = {k: [chr(c) for c in range(a, a + 300)] for k, a in (("ja", 0x4E00), ("ko", 0xAC00))}
    train = {k: ["".join(rng.choice(a, 900))] for k, a in signs.items()}
    model = L.Languages(train)
    texts = [train["ko"][0][100:400], "".join(rng.choice(signs["ja"] + signs["ko"], 700)), "".join(rng.choice(signs["ja"], 60))]
    got = model.phrases([L.fold(t) for t in texts])
    assert got.tolist() == [[parse(t, train[k][0], L.LANE) for k in model.names] for t in texts]


def test_languages_of_short_or_long_texts_alone(spark):
    rng = np.random.default_rng(2)
    words = {k: ["".join(rng.choice(list(a), 4)) for _ in range(60)] for k, a in (("mid", "abcdefgh"), ("short", "cdefghij"), ("long", "efghijkl"), ("tiny", "ghijklmn"))}
    say = lambda k, n: " ".join(rng.choice(words[k], n))
    sizes = {"mid": (80, 60), "short": (12, 300), "long": (3000, 6), "tiny": (2, 2)}
    docs = [(k, say(k, n)) for k, (n, times) in sizes.items() for _ in range(times)]
    train = L.training_texts(spark.createDataFrame(docs, "lang string, text string"))
    assert set(train) == set(sizes) and max(len(t) for texts in train.values() for t in texts) <= L.MAX_CHARS
    model = L.Languages(train)
    assert [model.predict([say(k, 40)])[0][0] for k in ("mid", "short", "long")] == ["mid", "short", "long"]
