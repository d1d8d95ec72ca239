"""Medians of everything before a date, block by block, against a plain reading."""

import datetime as dt
import statistics

import numpy as np
import pytest

from lodestrata.operators import medians
from lodestrata.operators.medians import expanding_median


@pytest.mark.parametrize(("least", "step"), [(3, 2), (40, 5), (40, 32), (512, 32)])
def test_blocks_carry_what_their_medians_need(spark, monkeypatch, least, step):
    monkeypatch.setattr(medians, "STEP", step)
    rng = np.random.default_rng(9)
    series = {
        "walk": np.cumsum(rng.normal(size=130)).tolist(), "rising": [float(i) for i in range(130)], "falling": [-float(i) for i in range(97)], "noise": rng.normal(size=131).tolist(),
        "ties": rng.integers(0, 3, 120).astype(float).tolist(), "same": [1.5] * 60, "one": [2.0], "gaps": [None if rng.random() < 0.4 else float(x) for x in rng.normal(size=90)], "none": [None, None],
    }
    rows = [(dt.date(2000, 1, 1) + dt.timedelta(days=int(i * (1 if a != "noise" else 1 + i % 5))), a, x) for a, xs in series.items() for i, x in enumerate(xs)]
    seen = set()
    rows = [r for r in rows if (r[0], r[1]) not in seen and not seen.add((r[0], r[1]))]
    got = {(r.asset, r.date): r.med for r in expanding_median(spark.createDataFrame(rows, "date date, asset string, ret double"), least).collect()}
    assert len(got) == len(rows)
    for a in series:
        past: list = []
        for d, x in sorted((d, x) for d, b, x in rows if b == a):
            want = statistics.median(past) if past else None
            assert got[a, d] == (pytest.approx(want) if want is not None else None), (a, d)
            if x is not None:
                past.append(x)
