import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, stems: str = "ka lo mi ter on sha ble ing pra du") -> str:
    rng = random.Random(seed)
    s = stems.split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in every column, empty and long texts, exact and near copies, repeated rows,
    and extra columns whose names the operators use themselves."""
    base = prose(1, 300)
    near = base.rsplit(" ", 1)[0] + " changed"
    rows = [(1, base), (2, base), (3, near), (4, prose(2, 80)), (5, ""), (6, None), (7, "   \n\t "), (8, "one two"), (9, prose(3, 20000)), (None, prose(4, 60)), (10, "| " * 200), (11, prose(5, 60) + " éß中 " + prose(6, 30)), (11, prose(5, 60) + " éß中 " + prose(6, 30)), (12, "und " * 120), (13, "#$%&|<>*" * 20)]
    out = []
    for i, (k, t) in enumerate(rows):
        out.append((k, t, None if i % 5 == 4 else "en" if i % 2 else "xx", None if i % 7 == 6 else f"s{i % 3}", None if i == 3 else len(t or ""), "a", 1, True, 2.5))
    df = spark.createDataFrame(out, DOCS + ", fp string, n_words int, kept boolean, score double")
    return df.withColumnsRenamed({"fp": "_k"}).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (9, 1, 0), (11, 1, 0), (10, 0, 0), (12, 0, 0), (13, 0, None), (4, 1, 0), (None, 1, 0), (99, None, 1)], "doc_id long, quality int, toxic int")
