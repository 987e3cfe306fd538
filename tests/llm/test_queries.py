"""Registered queries against their SQL twins, and the pipeline stage by stage against brute force."""

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tests.llm import brute
from twinsift.llm.oracles import ORACLES
from twinsift.llm.queries import QUERIES
from twinsift.operators.storage import stage

TABLES = "documents benchmark conversations labels".split()


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and len(QUERIES) == 13


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    result = connection.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert order(df.select(*columns).collect()) == order(result.fetchall())


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]

    def rows(df):
        return [(r.doc_id, r.text, r.source) for r in df.collect()]

    clean = stage(steps["toxicity"](spark, docs, sf_dir), "t")
    assert clean.columns == columns and 0 < clean.count() <= docs.count()
    lines = stage(steps["line_dedup"](spark, clean, sf_dir), "l")
    want = [(d, t) for d, _, dropped, t in brute.spread(rows(clean)) if not dropped or t.strip()]
    assert lines.columns == columns and order(r[:2] for r in rows(lines)) == order(want)
    single = stage(steps["near_dedup"](spark, lines, sf_dir), "n")
    kept = [(d,) for d, *_, keep in brute.near_duplicates(rows(lines)) if keep]
    assert single.columns == columns and order(r[:1] for r in rows(single)) == order(kept)
    fresh = stage(steps["decontamination"](spark, single, sf_dir), "d")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = [(d,) for d, *_, bad in brute.contamination(rows(single), items) if not bad]
    assert fresh.columns == columns and order(r[:1] for r in rows(fresh)) == order(left)
    packed = steps["packing"](spark, fresh, sf_dir).collect()
    assert {r.doc_id for r in packed} == {d for d, in left}


def test_pipeline_runs_whole(spark, sf_dir):
    assert contract.queries()["pipeline"](spark, sf_dir).count() > 0


def test_empty_tables(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES[:4]:
        empty = stage(function(spark, empty, sf_dir), "e")
        assert empty.count() == 0
    assert corpus_pipeline.packing(spark, empty, sf_dir).count() == 0
