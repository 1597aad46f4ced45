"""Operators over whole tables, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from magpie.operators import knn
from magpie.plans import registry
from magpie.plans.fixtures import Tables
from magpie.streaming import changes

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


@pytest.mark.parametrize("block", [20_000, 100])
def test_mutual_over_all_rows(t, monkeypatch, block):
    monkeypatch.setattr(knn, "QUERY_BLOCK", block)
    monkeypatch.setattr(knn, "CELLS", 1000)
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    # a tie in each direction
    e = e.unionByName(e.where("vec_id IN (20, 21)").withColumn("vec_id", F.col("vec_id") + F.when(F.col("vec_id") == 20, 100_000).otherwise(100_002)))
    a, b = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "lid"), e.where("vec_id % 20 <> 0").withColumnRenamed("vec_id", "rid")
    left, right = sorted((r.lid, r.v) for r in a.collect()), sorted((r.rid, r.v) for r in b.collect())
    assert len(left) == 26 and len(right) == 476
    s = (np.array([v for _, v in left])[:, None, :] * np.array([v for _, v in right])[None, :, :]).sum(axis=2)
    i, j = s.argmax(axis=1), s.argmax(axis=0)
    want = [(left[k][0], right[i[k]][0]) for k in range(len(left)) if j[i[k]] == k and s[k, i[k]] >= 0.25]
    got = knn.mutual(a, b, 0.25)
    assert sorted((r.lid, r.rid) for r in got.collect()) == sorted(want) and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_queue_over_all_events(t):
    state = F.when(F.col("event_id") % 3 == 0, "queued").when(F.col("event_id") % 3 == 1, "done").otherwise("running")
    # many jobs of one time
    jobs = t.events.select(F.col("event_id").alias("job_id"), F.when(F.col("event_id") < 4000, F.lit("2020-01-01").cast("timestamp_ntz")).otherwise(F.col("ts")).alias("ts"), state.alias("state"))
    rows = sorted(jobs.collect(), key=lambda r: (r.ts, r.job_id))
    of = lambda s: [r.job_id for r in rows if r.state == s]
    want = [(j, i + 1) for i, j in enumerate(of("queued"))] + [(j, None) for j in of("done")[-100:] + of("running")]
    out = changes.queue(jobs)
    assert out.columns == ["job_id", "ts", "state", "position"]
    assert sorted((r.job_id, r.position or 0) for r in out.collect()) == sorted((j, p or 0) for j, p in want)
    assert len(rows) == 10_000
    # no window over the jobs by their state alone: those that are, go over counts of ranges
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    by_state = [x for x in plan.splitlines() if "Window" in x and "row_number" in x and "[state#" in x and "__r#" not in x]
    assert not by_state


def test_all_pages(spark, t):
    pages = {r.page_id for r in t.paths().collect()}
    found = registry.QUERIES["template_match"](spark, SF).collect()
    assert {r.page_id for r in found} == pages and len(found) == len(pages) > 20 and all(r.found for r in found)
    boxes = registry.QUERIES["homography_box"](spark, SF).collect()
    assert {r.page_id for r in boxes} == pages and len(boxes) == len(pages)
    assert all(r.inliers >= 32 and abs(r.x1 - r.page_id) < 1 and abs(r.y2 - 50) < 1 for r in boxes)


@pytest.mark.parametrize("block", [20_000, 100])
def test_noisy_copies_are_duplicates(spark, t, monkeypatch, block):
    monkeypatch.setattr(knn, "QUERY_BLOCK", block)
    monkeypatch.setattr(knn, "CELLS", 50_000)
    rng = np.random.default_rng(2)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in t.embeddings.collect()]
    for i, v in rows[:60:2]:
        w = np.array(v) / np.linalg.norm(v) + rng.normal(0, 0.001, len(v))
        rows.append((i + 10_000, (w / np.linalg.norm(w)).tolist()))  # a score of some 0.99997
        far = np.array(v) / np.linalg.norm(v) + rng.normal(0, 0.004, len(v))
        rows.append((i + 20_000, (far / np.linalg.norm(far)).tolist()))  # some 0.9995
    rows += [(i + 30_000, v) for i, v in rows[:10]]
    x = np.array([v for _, v in rows])
    want = {}
    for k, (i, v) in enumerate(rows):
        s = (x[:k] * x[k]).sum(axis=1) if k else np.zeros(0)
        s[[np.array_equal(y, v) for y in x[:k].tolist()]] = 2
        want[i] = rows[int(s.argmax())][0] if k and s.max() >= 0.9999 else i
    made = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    got = {r.vec_id: (r.first_id, r.duplicate) for r in knn.exact_duplicates(made).collect()}
    assert got == {i: (j, i != j) for i, j in want.items()}
    assert all(want[i] == i % 10_000 for i in want if i < 20_000 or i >= 30_000) and sum(i != j for i, j in want.items()) == 40
