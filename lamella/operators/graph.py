"""Connected components of an edge table (H17), also with a potential along the edges.

Edges are first joined up within each task into stars, so what is left to shuffle grows with the nodes of the tasks and not
with the edges. Stars of different tasks are then joined by alternating large-star and small-star steps, so the number of
rounds grows with the logarithm of the longest path. The smallest neighbours of each half-round, a partial aggregate, are
stored before they are joined, so that both sides of the join are plain exchanges and AQE can split a hub's edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.plans.session import checkpointed

#: Edges that a task joins up at a time.
SLICE = 1 << 18


def stars(u: np.ndarray, v: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(node, root, steps)`` of nodes that aren't roots, from edges u - v with ``steps`` = potential of u less that of v, a row each.

    Roots are the smallest nodes. Of edges that contradict each other the first by (u, v, steps) decides.
    """
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    order = np.lexsort((*steps, b, a))
    a, b, steps = a[order], b[order], steps[:, order]
    root, own = np.arange(len(nodes)), np.zeros((len(steps), len(nodes)), steps.dtype)
    while True:
        ra, rb = root[a], root[b]
        differ = np.flatnonzero(ra != rb)
        if not len(differ):
            break
        a, b, steps, ra, rb = a[differ], b[differ], steps[:, differ], ra[differ], rb[differ]
        over = steps + own[:, b] - own[:, a]  # potential of a's root less that of b's
        hi, lo, sign = np.maximum(ra, rb), np.minimum(ra, rb), np.where(ra > rb, 1, -1)
        first = np.lexsort((np.arange(len(hi)), lo, hi))
        first = first[np.concatenate(([True], hi[first][1:] != hi[first][:-1]))]
        root[hi[first]] = lo[first]
        own[:, hi[first]] = over[:, first] * sign[first]
        while not np.array_equal(jump := root[root], root):
            own = own + own[:, root] * (root != np.arange(len(root)))
            root = jump
    moved = np.flatnonzero(root != np.arange(len(root)))
    return nodes[moved], nodes[root[moved]], own[:, moved]


def _starred(edges: DataFrame, steps: list[str]) -> DataFrame:
    """Edges ``(u, v, *steps)`` of longs, those of a task replaced by stars a slice at a time; u is the larger end."""
    size = SLICE

    def starred(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        u, v, *own = (np.concatenate(x) for x in zip(*held, strict=True))
        node, root, own = stars(u, v, np.array(own, np.int64).reshape(len(steps), len(u)))
        return [node, root, *own]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows > size:
                held = [starred(held)]
                rows = len(held[0][0])
                if rows > size // 2:  # mostly nodes of their own: sent on as they are
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["u", "v", *steps])
                    held, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in starred(held)], names=["u", "v", *steps])

    return edges.mapInArrow(join, ", ".join(f"{c} long" for c in ("u", "v", *steps)))


def _distinct(edges: DataFrame, steps: list[str]) -> DataFrame:
    """One row for each pair of ends; of contradicting steps the smallest."""
    if not steps:
        return edges.distinct()
    return edges.groupBy("u", "v").agg(F.min(F.struct(*steps)).alias("s")).select("u", "v", *[F.col(f"s.{s}").alias(s) for s in steps])


def _settled(e: DataFrame) -> bool:
    """Whether every node has one edge, to a root."""
    ends = e.groupBy("u").agg(F.count("*").alias("n"), F.lit(False).alias("is_root")).unionByName(e.select(F.col("v").alias("u")).distinct().select("u", F.lit(1).cast("long").alias("n"), F.lit(True).alias("is_root")))
    return ends.groupBy("u").agg(F.sum("n").alias("n")).where("n > 1").isEmpty()


def rooted(edges: DataFrame, steps: list[str], max_rounds: int = 60) -> DataFrame:
    """``(node, root, *steps)`` for every node of edges ``(u, v, *steps)`` between longs; steps are the node's potential less the root's."""
    e = edges.where("u <> v")
    flip = [(-F.col(s)).alias(s) for s in steps]
    e = e.select("u", "v", *steps).where("u > v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), *flip).where("u > v"))
    e = checkpointed(_starred(_distinct(_starred(e, steps), steps), steps))
    for _ in range(max_rounds):
        if _settled(e):
            break
        # large star: every larger neighbour of u moves to the smallest neighbour of u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), *flip))
        least = both.groupBy("u").agg(F.min(F.struct("v", *steps)).alias("m"))
        own = F.col("u") < F.col("m.v")
        least = checkpointed(least.select("u", F.least("u", "m.v").alias("m"), *[F.when(own, 0).otherwise(F.col(f"m.{s}")).alias(f"m_{s}") for s in steps]))
        onward = lambda df: [(F.col(f"m_{s}") - F.col(s)).alias(s) for s in steps]
        e = checkpointed(_distinct(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), *onward(both)), steps))
        # small star: every smaller neighbour of u, and u itself, move to the smallest of them
        least = e.groupBy("u").agg(F.min(F.struct("v", *steps)).alias("m"))
        least = checkpointed(least.select("u", F.col("m.v").alias("m"), *[F.col(f"m.{s}").alias(f"m_{s}") for s in steps]))
        moved = e.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"), *onward(e))
        kept = least.select("u", F.col("m").alias("v"), *[F.col(f"m_{s}").alias(s) for s in steps])
        e = checkpointed(_starred(_distinct(moved.unionByName(kept), steps), steps))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"), *steps).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root"), *[F.lit(0).cast("long").alias(s) for s in steps]))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", steps: list[str] | None = None) -> DataFrame:
    """``(node, root)`` for every node of an undirected edge table; root is the smallest node reachable.

    With ``steps``, columns of whole numbers that say how far the potential of ``a`` is from that of ``b``, also how far
    each node's is from its root's. Edges that contradict each other are settled one way or the other; see
    :func:`contradictions`. Ends of any orderable type are numbered in their order first, longs are their own numbers. Edges
    with a null end or step and self-loops are ignored; repeated edges count once; an empty table gives an empty result.
    """
    steps = list(steps or [])
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y"), *[F.col(s).cast("long").alias(s) for s in steps]).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).na.drop(subset=steps or ["x"])
    if dict(e.dtypes)["x"] == dict(e.dtypes)["y"] == "bigint":
        return rooted(e.withColumnsRenamed({"x": "u", "y": "v"}), steps)
    e = checkpointed(e.distinct())
    ends = e.select(F.explode(F.array("x", "y")).alias("end")).distinct()
    # range partitions hold the ends in their order, so that numbers order as the ends do
    # and what is known of its size is a guess from compressed files, so it is never broadcast
    number = checkpointed(ends.repartitionByRange("end").sortWithinPartitions("end").select("end", F.monotonically_increasing_id().alias("id"))).hint("merge")
    e = e.join(number.select(F.col("end").alias("x"), F.col("id").alias("u")), "x").join(number.select(F.col("end").alias("y"), F.col("id").alias("v")), "y")
    # ends that lie near each other in their order are often joined, and so meet in a task before the first round
    found = checkpointed(rooted(e.select("u", "v", *steps).repartitionByRange("u", "v"), steps))
    named = found.join(number.select(F.col("end").alias("named"), F.col("id").alias("node")), "node").join(number.select(F.col("end").alias("top"), F.col("id").alias("root")), "root")
    return named.select(F.col("named").alias("node"), F.col("top").alias("root"), *steps)


def contradictions(edges: DataFrame, potentials: DataFrame, steps: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """The edges whose steps aren't the difference of their ends' potentials; a cycle that contradicts itself has at least one."""
    one = potentials.select(F.col("node").alias(a), *[F.col(s).alias(f"a_{s}") for s in steps])
    two = potentials.select(F.col("node").alias(b), *[F.col(s).alias(f"b_{s}") for s in steps])
    wrong = F.lit(False)
    for s in steps:
        wrong = wrong | (F.col(f"a_{s}") - F.col(f"b_{s}") != F.col(s))
    return edges.join(one.hint("merge"), a).join(two.hint("merge"), b).where(wrong).select(*edges.columns)
