"""Edges of members, made without a gathering of all pairs."""

from glyphmill.operators import graph


def test_member_edges_are_distinct(spark):
    rows = [(1, "P", "protocol", "f", "s1"), (2, "C", "class", "f", "s2"), (9, "Q", "protocol", "f", "s1")]
    rows += [(10, "a", "method", "s1", None), (10, "b", "method", "s1", None), (10, "a", "method", "s3", None), (11, "a", "method", "s2", None), (11, "b", "method", "s2", None), (12, "a", "method", "s4", None), (12, "a", "method", "s5", None), (13, "a", "method", "s1", None), (14, "a", "function", "s2", None), (15, None, "method", "s2", None), (16, "a", "method", None, None)]
    out = graph.member_edges(spark.createDataFrame(rows, "id long, name string, kind string, scope_id string, own_scope string"))
    methods = [r for r in rows if r[2] in ("method", "function")]
    want = {(2, r[0], "call") for r in methods if r[3] == "s2"}
    want |= {(r[0], q[0], "typeReference") for r in methods if r[3] == "s1" for q in methods if q[1:3] == r[1:3] and r[1] and q[3] not in (None, r[3])}
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    # pairs are not gathered once more: all of them are made by a join, and those of several names alone are made distinct
    assert out._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
