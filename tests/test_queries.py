"""Every survey query against its SQL, and the graph helper against a plain union-find."""

import random

import duckdb
import pytest

from lamella.operators import graph
from lamella.operators.graph import connected_components
from lamella.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = ("events", "orders", "part", "lineitem", "supplier", "customer", "embeddings")


def plain(rows):
    return sorted([tuple(None if v is None else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5, 5), (None, 3), (7, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_potentials(spark, monkeypatch, size):
    """Every node's steps to its root, with slices of a task of any size; a wrong edge is found, and only its component is in doubt."""
    monkeypatch.setattr(graph, "SLICE", size)
    rng = random.Random(size)
    at = {i: (rng.randrange(-50, 50), rng.randrange(90)) for i in range(700)}
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(400 + i, 401 + i) for i in range(200)] + [(3, 3), (None, 4), (650, 651), (651, 652), (652, 650)]
    edges = [(a, b, None if a is None else at[a][0] - at[b][0], at[b][1] * 0 if a is None else at[a][1] - at[b][1]) for a, b in edges]
    edges[-1] = (652, 650, at[652][0] - at[650][0] + 1, at[652][1] - at[650][1])
    rows = spark.createDataFrame(edges, "a long, b long, c long, r long").repartition(3)
    found = connected_components(rows, steps=["c", "r"])
    plain = {r.node: r.root for r in connected_components(rows).collect()}
    got = {r.node: (r.root, r.c, r.r) for r in found.collect()}
    assert {n: root for n, (root, *_) in got.items()} == plain
    assert all((c, r) == (at[n][0] - at[root][0], at[n][1] - at[root][1]) for n, (root, c, r) in got.items() if n < 650)
    wrong = graph.contradictions(rows, found, ["c", "r"]).collect()
    assert len(wrong) == 1 and {wrong[0].a, wrong[0].b} <= {650, 651, 652}
    texts = connected_components(rows.selectExpr("cast(a AS string) AS a", "cast(b AS string) AS b", "c", "r"), steps=["c", "r"]).collect()
    assert all((t.c, t.r) == (at[int(t.node)][0] - at[int(t.root)][0], at[int(t.node)][1] - at[int(t.root)][1]) and t.root <= t.node for t in texts if int(t.node) < 650) and len(texts) == len(got)
    assert connected_components(rows.limit(0), steps=["c"]).collect() == []
