import random
import re
import zlib
from collections import Counter

import pytest

from lodestrata.llm import spelling


def brute(rows: list[tuple]) -> dict[str, tuple]:
    counts: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    partners = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in partners.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(partners[w]), n[form[w]] if form[w] else None)
    return out


def got(df) -> dict[str, tuple]:
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("range_words", [4, 200_000])
def test_against_brute_force(spark, range_words):
    rng = random.Random(3)
    words = []
    for stem in ("aaabbb", "letter", "spelling", "Zoëtrope", "ÀÉÿççç", "nearly"):
        words += [stem] * rng.choice([700, 150, 130])
        for _ in range(14):
            at, c = rng.randrange(len(stem) + 1), rng.choice("abceltÉç")
            kin = rng.choice([stem[:at] + c + stem[at:], stem[:at] + stem[at + 1 :], stem[:at] + c + stem[at + 1 :]])
            words += [kin] * rng.choice([4, 5, 6, 9, 30])
    words += ["kalmor"] * 6 + ["kalmora"] * 45 + ["kalmorab"] * 300
    words += ["q" * 3000 + "x"] * 6 + ["q" * 3000] * 40 + ["q" * 2999] * 300
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "-", "÷1 ", "×"]).join(words[i::60])) for i in range(60)] + [(None, " letter" * 20), (None, " letter" * 20), (70, None), (71, ""), (72, "1 2 3 ÷ ×")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    want = brute(rows)
    assert sum(r[0] is not None for r in want.values()) > 10 and any(r[0] != r[1] and r[0] for r in want.values())
    assert got(spelling.variants(df, range_words)) == want


def test_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_numbers_tell_paths_apart_over_ranges(spark):
    words = sorted({"".join(random.Random(i).choices("ab", k=6 + i % 5)) for i in range(300)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    for backwards in (False, True):
        rows = spelling.numbered(df, backwards, 13).collect()
        node = {}
        for r in rows:
            key = r.word[::-1] if backwards else r.word
            for i, number in enumerate(r.nodes):
                assert node.setdefault(key[:i], number) == number
        assert len(set(node.values())) == len(node)
    assert [r.word for r in sorted(spelling.numbered(df, False, 13).collect(), key=lambda r: r.id)] == words
