import re

import corpus_pipeline
import pytest
from test_decontam import words
from test_simhash import brute, components

from lodestrata.llm import mixing, quality
from lodestrata.llm.common import table, written
from lodestrata.llm.secrets import MASK


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The rows before and after each stage."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir)))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_take_effect_and_keep_columns(stages):
    sizes = [s.count() for s in stages]
    for s in stages[1:5]:
        assert s.columns == stages[0].columns and s.dtypes == stages[0].dtypes
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] >= sizes[5] > 0
    assert stages[5].columns == [*stages[0].columns, "copies"]


def test_quality_stage(spark, sf_dir, stages):
    """test_quality holds rules() to a plain model; here the stage to rules()."""
    kept = {r.doc_id for r in quality.rules(stages[0], table(spark, sf_dir, "labels")).collect() if r.kept}
    assert set(rows(stages[1])) == kept and all(rows(stages[0])[k] == r for k, r in rows(stages[1]).items())


def test_near_duplicate_stage(stages):
    before = sorted(rows(stages[1]).values(), key=lambda r: r.doc_id)
    label = components([(r.doc_id, brute(r.text)) for r in before])
    assert set(rows(stages[2])) == set(label) and all(rows(stages[1])[k] == r for k, r in rows(stages[2]).items())


def test_decontamination_stage(spark, sf_dir, stages):
    grams = {}
    for item in table(spark, sf_dir, "benchmark").collect():
        w = words(item.text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(n, set()).add(tuple(w[i : i + n]))
    clean = set()
    for k, r in rows(stages[2]).items():
        w = words(r.text)
        if not any(tuple(w[i : i + n]) in g for n, g in grams.items() for i in range(len(w) - n + 1)):
            clean.add(k)
    assert set(rows(stages[3])) == clean


def test_secret_stage(spark, sf_dir):
    """The tables' secrets are 40 hex digits assigned to a token; the smallest has none."""
    larger = sf_dir.replace("0.001", "0.01")
    docs = table(spark, larger, "documents")
    after, masked = rows(corpus_pipeline.secret_scan(spark, docs, larger)), 0
    for k, r in rows(docs).items():
        want = re.sub(r'(?i)(?<=token = ")[0-9a-f]{40}(?=")', MASK, r.text)
        masked += want != r.text
        assert after[k].text == want and after[k].n_chars == (len(want) if want != r.text else r.n_chars)
    assert masked


def test_mixing_stage(stages):
    before = rows(stages[4])
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for k, r in before.items()}
    target = {r.source: r.target for r in mixing.targets(stages[4].select("source", mixing.word_count().alias("size"))).collect()}
    taken, largest = dict.fromkeys(target, 0), dict.fromkeys(target, 0)
    for k, r in before.items():
        largest[r.source] = max(largest[r.source], size[k])
    for k, r in rows(stages[5]).items():
        assert 1 <= r.copies <= 2 and r[:-1] == tuple(before[k])
        taken[r.source] += r.copies * size[k]
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)


def test_odd_rows_through_all_stages(spark, sf_dir, documents, empty):
    for first in (documents, empty):
        for start in range(5):  # every stage may be the first
            docs = first
            for _, stage in corpus_pipeline.STAGES[start:]:
                docs = written(stage(spark, docs, sf_dir))
                assert docs.columns[: len(first.columns)] == first.columns
            assert docs.columns[-1] == "copies" and (first is documents) >= (docs.count() > 0)


def test_registered(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")}
    assert set(e.oracle_sql()) <= names
