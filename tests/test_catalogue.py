"""Every query of the catalogue against its SQL."""

import duckdb
import pytest

from spandrel.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return "" if x is None or x != x else round(float(x), 9) if isinstance(x, float) else str(x)


def hold_against_sql(spark, sf, query, sql):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = query(spark, sf)
    want = db.sql(sql)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    ours = sorted([str([plain(r[c]) for c in names]) for r in got.collect()])
    theirs = sorted([str([plain(dict(zip(want.columns, r, strict=True))[c]) for c in names]) for r in want.fetchall()])
    assert ours == theirs


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_oracle(spark, sf, name):
    hold_against_sql(spark, sf, catalogue.QUERIES[name], catalogue.ORACLES[name])


def hold_csv_against_sql(spark, folder, texts):
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    sql = catalogue.ORACLES["report_csv"].replace("FROM documents", f"FROM '{folder}/documents.parquet/*.parquet'")
    got = sorted([tuple(r) for r in catalogue.report_csv(spark, str(folder)).select("doc_id", "line").collect()], key=str)
    assert got == sorted(duckdb.connect().sql(sql).fetchall(), key=str)
    return got


def test_csv_beside_ties(spark, tmp_path):
    """Ratios just above a tie (3161 / 80: 3951.2500000000005) and on one (18368.75 and 23606.25)."""
    got = hold_csv_against_sql(spark, tmp_path, [(4739, "a" * 80), (37459, "b" * 80), (250359, "é" * 40), (1, "c" * 16), (3, "d" * 16)])
    assert {(4739, "d4739,80,3161,3951.3,deflate,true"), (1, "d1,16,2939,18368.8,deflate,true"), (3, "d3,16,3777,23606.2,deflate,true")} < set(got)


def test_csv_of_odd_rows(spark, tmp_path):
    hold_csv_against_sql(spark, tmp_path, [(0, ""), (3, None), (None, "d"), (-5, "e" * 70)])


def test_without_oracle(spark, sf):
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"compression_effect"}
    rows = catalogue.compression_effect(spark, sf).filter("original_size >= 4096")
    assert rows.count() and rows.filter("not smaller").count() == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["files", "total_original", "all_crc_valid"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_workers_need_no_path(tmp_path):
    """Queries work where Python workers can find the package neither by their folder nor by PYTHONPATH."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parent.parent)
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert __spark_entry__.queries()["roundtrip_pages"](spark, "/root/testdata/sf0.001").filter("error_kind is null").count() == 50
assert __spark_entry__.entry(spark).first()["all_crc_valid"]
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=170)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]
