"""The pipeline's stages, and the registered queries that have SQL."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from quizspark.llm.queries import QUERIES, SQL
from tools.check_oracle import TABLES, canonical

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, cursor.fetchall())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids, before = docs.columns, {r.doc_id for r in docs.collect()}, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "retrieval packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids and kept
        if name in ("quality classifier", "exact dedup", "near-dedup"):
            assert docs.count() == len(kept) < before
            before = docs.count()
        ids = kept


def test_no_operator_is_used_elsewhere():
    root = Path(__file__).resolve().parents[2]
    outside = [p for p in (root / "quizspark").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in outside if "quizspark.llm" in p.read_text()]
