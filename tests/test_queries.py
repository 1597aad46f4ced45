"""Registered queries against their SQL on the smallest tables, and properties of the operators."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from magpie.config import SearchConfig, page_args, parse_list
from magpie.operators import knn, pixels, votes
from magpie.plans import registry
from magpie.plans.fixtures import Tables

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    rows = sorted(repr(tuple(plain(r[c]) for c in sorted(got.columns))) for r in got.collect())
    if sql := registry.ORACLE_SQL.get(name):
        want = duck.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert rows == sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in want.fetchall())
    else:
        assert rows


def test_planted_page_wins(spark):
    t = Tables(spark, SF)
    rng = np.random.default_rng(3)
    side = t.keypoints()
    rows = []
    for r in side.where("page_id = 20").collect():
        v = np.array(r.v) + rng.normal(0, 0.02, len(r.v))
        rows.append((0, r.vec_id, (v / np.linalg.norm(v)).tolist()))
    q = spark.createDataFrame(rows, "query_id long, kp long, q array<double>")
    found = votes.votes(knn.top_matches(q, side, 5, 0.7)).orderBy(F.desc("votes")).collect()
    assert (found[0].page_id, found[0].votes) == (20, 8) and len(found) == 1


def test_paths_of_execution_agree(spark):
    t = Tables(spark, SF)
    a, b = (knn.top_matches(t.queries(), t.keypoints(), 5, 0.25, path=p).select("kp", "vec_id", "rank").collect() for p in ("arrow", "expression"))
    assert sorted(a) == sorted(b) and a


def test_stream_equals_batch_with_restart(spark, tmp_path):
    from magpie.streaming.votes import stream_votes, total_votes

    t = Tables(spark, SF)
    side, config = t.keypoints(), SearchConfig(threshold=0.25)
    queries = t.queries().cache()

    def put(chunks):
        for c in chunks:
            side.where(F.col("chunk_no") == c).coalesce(1).write.mode("append").parquet(str(tmp_path / "chunks"))

    for chunks in ([0, 1], [2, 3]):
        put(chunks)
        stream_votes(spark, str(tmp_path / "chunks"), side.schema, queries, str(tmp_path / "out"), str(tmp_path / "cp"), config).awaitTermination()
    want = votes.votes(knn.top_matches(queries, side, 5, 0.25))
    assert sorted(total_votes(spark, str(tmp_path / "out")).collect()) == sorted(want.collect())


def test_homography_and_hamming():
    rng = np.random.default_rng(0)
    a = rng.random((40, 2)) * 100
    b = a * 0.5 + 7
    b[:10] = rng.random((10, 2)) * 300
    got = pixels.homography(a, b, (100, 100))
    assert got["inliers"] >= 30 and abs(got["x1"] - 7) < 1 and abs(got["y2"] - 57) < 1
    d = rng.integers(0, 256, (20, 32)).astype(np.uint8)
    assert pixels.hamming_matches(d, d[::-1]) == 20 and pixels.hamming_matches(d[:3], d) == 0


def test_parameters():
    assert page_args(3, 20) == (40, 20) and parse_list(" a, ,b") == ["a", "b"] and parse_list(" ") is None
    with pytest.raises(ValueError):
        SearchConfig(k=0)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
