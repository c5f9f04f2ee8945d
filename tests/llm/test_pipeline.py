"""The pipeline's stages against brute force, and every registered query of the subpackage that SQL can express."""

import corpus_pipeline
import pytest
from llm import helpers as H
from test_catalogue import hold_against_sql

from spandrel.llm import mixing, quality_gam
from spandrel.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    schema = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality classifier", "line dedup", "MinHash near-dedup", "source mixing", "best-fit packing"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")

    good = stage["quality classifier"](spark, docs, DATA).cache()
    assert good.columns == schema
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality_gam.quality_scores(docs, labels).filter("predicted = 1").collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert sum(d not in kept for d, q in truth.items() if q == 1) <= 0.02 * len(truth)

    lined = stage["line dedup"](spark, good, DATA).cache()
    want = {r[0]: r[3] for r in H.lines([tuple(r) for r in good.collect()])}
    assert lined.columns == schema and {r["doc_id"]: H.sha(r["text"]) for r in lined.collect()} == want

    single = stage["MinHash near-dedup"](spark, lined, DATA).cache()
    rows = [tuple(r) for r in lined.collect()]
    assert single.columns == schema and {r["doc_id"] for r in single.collect()} == {r[0] for r in H.components(rows, 5) if r[3]}

    mixed = stage["source mixing"](spark, single, DATA).cache()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed_counts(single, corpus_pipeline.MIXTURE).collect()}
    assert mixed.columns == schema and min(copies.values()) >= 1 and mixed.count() == sum(copies.values())

    packed = stage["best-fit packing"](spark, mixed, DATA)
    slots = [(r["sequence_id"], r["offset"], r["length"]) for r in packed.collect()]
    from llm.test_counts import check_slots

    check_slots(slots)
    assert sum(n for *_, n in slots) > 0.99 * 1024 * len({s for s, *_ in slots})


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"] and rows.count()


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, sf, name):
    hold_against_sql(spark, sf, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= spark.read.parquet(f"{sf}/documents.parquet").count()


def test_registration():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
