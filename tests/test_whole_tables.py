"""Queries take whole tables."""

import random

from gridloom.plans import registry

SF = "/root/testdata/sf0.001"


def test_gap_filling_takes_all_event_types(spark):
    kinds = {r[0] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_type").distinct().collect()}
    assert len(kinds) == 5
    for name in ("seasconv_fill", "seasconv_qa"):
        assert {r.grp.split(".")[0] for r in registry.QUERIES[name](spark, SF).select("grp").distinct().collect()} == kinds


def test_points_of_all_nations(spark):
    want = {r[0] for r in spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey").collect()}
    assert {r[0] for r in registry.QUERIES["point_query"](spark, SF).select("pt_id").distinct().collect()} == want


def test_stacking_uses_every_dimension(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, [r.random() for _ in range(63)] + [float(i % 2 * 10)], i % 2) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x.vec_id: x["class"] for x in registry.QUERIES["stacking"](spark, str(tmp_path)).collect()}
    kinds = {k: {got[i] for i in got if i % 2 == k} for k in (0, 1)}
    assert len(kinds[0]) == len(kinds[1]) == 1 and kinds[0] != kinds[1]
