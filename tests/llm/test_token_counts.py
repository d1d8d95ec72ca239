import random

import numpy as np
import pytest

from lodestrata.llm import token_counts as T


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(f"{T.FOLDER}/{T.VOCABULARY}")


def test_remembered_pieces_equal_whole_encoding(encoder, documents):
    rng = random.Random(0)
    pool = [chr(c) for c in [*range(1, 0x250), 0x2003, 0x2028, 0x85, 0xA0, 0x3000, 0x200B, 0x660, 0x4E2D, 0x1F600, 0xFB01, 0x10D0]]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|>", "a" * 5000, " " * 3000]
    for t in texts:
        assert encoder.length(t) == len(encoder.encoding.encode_ordinary(t))


def test_long_pieces_are_not_remembered(encoder):
    text = " ".join("x" * n + "y" for n in range(60, 3000, 97)) + " short"
    assert encoder.length(text) == len(encoder.encoding.encode_ordinary(text))
    assert max(map(len, encoder.known)) <= T.LONGEST and " short" in encoder.known


def test_histogram_against_all_lengths(spark, documents, encoder):
    n = np.array(sorted(encoder.length(r.text or "") for r in documents.select("text").collect()))
    hist = T.histogram(T.encoded_lengths(documents))
    for r in hist.collect():
        x = r.n_tokens
        assert (r.docs, r.docs_longer, r.tokens_at_most, r.tokens_total, r.truncated_total) == ((n == x).sum(), (n > x).sum(), n[n <= x].sum(), n.sum(), np.minimum(n, x).sum())
        assert r.share_at_most == pytest.approx((n <= x).mean())
    limits = [0, 7, 128, 5000, 10**6]
    assert {r.context_limit: (r.docs_longer, r.truncated_total) for r in T.at_limits(hist, limits).collect()} == {x: ((n > x).sum(), np.minimum(n, x).sum()) for x in limits}
    shares = [0.1, 0.5, 0.9, 1.0]
    assert {r.share: r.n_tokens for r in T.quantiles(hist, shares).collect()} == {q: n[int(np.ceil(q * len(n) - 1e-9)) - 1] for q in shares}


def test_empty_table(spark, empty):
    assert T.histogram(T.encoded_lengths(empty)).count() == 0
