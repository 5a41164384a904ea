import importlib.util
from pathlib import Path

import corpus_pipeline as c
from redactum.llm import decontaminate, line_dedup
from redactum.llm.common import Workspace

_spec = importlib.util.spec_from_file_location("near_brute", Path(__file__).with_name("test_near.py"))
_near = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_near)
near_components = _near.brute
SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    space, kept = Workspace(spark, "t"), [docs.select(*c.COLUMNS)]
    for _, stage in c.STAGES:
        kept.append(space.write(stage(spark, kept[-1], SF), "s"))
    assert all(tuple(d.columns) == c.COLUMNS for d in kept[:-1])
    rows = [{(r.doc_id): r for r in d.collect()} for d in kept]
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:], strict=False))
    # line dedup: what is left has no line twice
    lines = [tuple(x.split()) for r in rows[2].values() for x in r.text.split("\n") if x.split()]
    assert len(lines) == len(set(lines)) and all(r.n_chars == len(r.text) for r in rows[2].values())
    # near duplicates: the first of each group of the stage's own input
    want = {i for i, root in near_components([(r.doc_id, r.text) for r in rows[2].values()], 5, 4, 5).items() if i == root}
    assert set(rows[3]) == want
    # contaminated documents are gone, the others stay
    bad = {r.doc_id for r in decontaminate.contamination(kept[3], spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert set(rows[4]) == set(rows[3]) - bad
    assert c.run(spark, SF).count() == kept[5].count() and c.ORACLE_SQL is None


def test_good_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*c.COLUMNS)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in c.quality_classifier(spark, docs, SF).collect()}
    assert len(good - kept) <= 0.02 * len(good)


def test_awkward_rows(spark, awkward):
    """Nulls, empty and very long texts, repeats and extra columns through every stage but the first, which takes all."""
    docs, space = awkward, Workspace(spark, "t")
    assert c.quality_classifier(spark, docs.select(*c.COLUMNS), SF).count() <= docs.count()
    for name, stage in c.STAGES[1:]:
        docs = space.write(stage(spark, docs.select(*c.COLUMNS), SF), "s")
        ids = [r.doc_id for r in docs.collect()]
        if name == "line dedup":
            assert ids.count(1) == 2 and 2 not in ids and {3, 4, 5} <= set(ids)
        if name == "MinHash near-dedup":
            assert ids.count(1) == 1 and {3, 4, 5, None} <= set(ids)
    assert {r.copy for r in docs.collect()} <= {0, 1}


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*c.COLUMNS).limit(0)
    for _, stage in c.STAGES:
        docs = stage(spark, docs, SF).select(*c.COLUMNS)
        assert docs.count() == 0
    assert line_dedup.NEAR_WORDS >= 10
