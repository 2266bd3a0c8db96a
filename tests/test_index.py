"""The hyperplane index against exact neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import retrieval


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 24))
    x = np.repeat(centres, 25, axis=0) + 0.2 * rng.normal(size=(1500, 24))
    rows = [(i, v.tolist(), f"g{i % 2}") for i, v in enumerate(x)] + [(5000, None, "g0"), (5001, [0.0] * 24, "g0")]
    return x, spark.createDataFrame(rows, "id long, v array<double>, g string").repartition(4)


def test_recall_and_work_of_the_index(spark, clustered):
    x, bank = clustered
    asked = bank.where("id % 100 = 0").select(F.col("id").alias("q"), "v")
    found = retrieval.indexed_neighbours(asked, bank, "q", "id", "v", 10, bits=8, tables=8)
    assert retrieval.recall_of(found, asked, bank, "q", "id", "v", 10) >= 0.9
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = found.collect()
    for r in rows:
        assert r.sim == pytest.approx(float(unit[r.q] @ unit[r.id]), abs=1e-6)  # ranked by exact cosines
    assert {r.rank for r in rows if r.q == 0} == set(range(1, 11)) and next(r.id for r in rows if r.q == 0 and r["rank"] == 1) == 0
    # a query meets a small part of the bank
    buckets = retrieval._with_buckets(bank.select("id", "v"), "v", 8, 8, 42, [])
    met = retrieval._with_buckets(asked, "v", 8, 8, 42, []).select("q", "_bucket").join(buckets.select("id", "_bucket"), "_bucket").select("q", "id").distinct()
    assert met.count() < 0.25 * asked.count() * bank.count()
    assert buckets.groupBy("id").count().where("count <> 8").isEmpty()  # every row stands in each table


def test_keys_and_own_rows(spark, clustered):
    _, bank = clustered
    asked = bank.where("id % 100 = 0").select(F.col("id").alias("q"), "v", "g")
    found = retrieval.indexed_neighbours(asked, bank, "q", "id", "v", 3, bits=4, tables=6, keys=["g"], others_only=True).collect()
    assert found and all(r.id != r.q and r.id % 2 == r.q % 2 for r in found)
    assert retrieval.indexed_neighbours(asked.where("false"), bank, "q", "id", "v", 3, 4, 6).count() == 0


def test_recall_of_the_registered_query(spark):
    from cadenza.plans.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "asked")
    assert retrieval.recall_of(QUERIES["indexed_neighbours"](spark, folder), asked, rows, "asked", "vec_id", "embedding", 10) >= 0.9
