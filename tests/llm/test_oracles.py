"""Queries of the subpackage beside their SQL: on a given table, and on planted copies where that holds none."""

import os

import numpy as np
import pytest

from barloom.llm import queries
from oracle_compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF_DIR), name, queries.QUERIES[name], queries.ORACLES[name], SF_DIR) is None


def test_planted_vectors_equal_sql(spark, tmp_path):
    """The given vectors hold no pair at the threshold, so clusters, copies and odd vectors are planted."""
    pick = np.random.default_rng(7)
    base = pick.standard_normal((40, 24))
    near = [b + s * pick.standard_normal(24) for b in base[:12] for s in (0.0, 0.05, 0.2, 0.3)]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate([*base, *near, *near[:6]])]
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [1.0, None] * 12), (1004, []), (1005, [2.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duck(str(tmp_path))
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    name = "op1_embedding_near_dedup"
    assert compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], str(tmp_path)) is None
    assert con.execute(queries.ORACLES[name]).df().n_links.sum() > 60
