"""A coherent layout from pairwise links: robust, weighted least squares for translations.

The links of a component ask for positions whose differences they measured. A component of few links is solved in one
task, many components to a task. A larger one is solved on tables: conjugate gradients for the links' normal equations,
links and positions joined by node, scalar products summed per component. Blocks of nodes whose numbers lie together are
solved exactly in their tasks and a coarse equation, a node for each block, ties the blocks together, so the rounds don't
grow with the length of a chain. Weights follow the residuals between solves; at the end links too far off are dropped and
what is left is solved again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.graph import connected_components
from lamella.plans.session import checkpointed, forget, saved

#: Fixed values of the rule: least weight of a link, residual up to which it has its whole weight, residual that drops it, reweightings, rounds.
LEAST_WEIGHT, HUBER, MOST, REWEIGHTS, ROUNDS = 0.05, 3.0, 15.0, 12, 4
#: Links of a component that one task solves, nodes of a block of a larger one, nodes up to which a block's equations are a dense matrix.
LOCAL_LINKS, BLOCK, DENSE = 20_000, 2048, 300


def solve(a: np.ndarray, b: np.ndarray, w: np.ndarray, right: np.ndarray, ground: np.ndarray) -> np.ndarray:
    """``(2, n)`` with (L + diag(ground)) x = right, L the Laplacian of links a - b with weights w; without ground node 0 is at 0."""
    n = len(ground)
    diagonal = np.bincount(a, w, n) + np.bincount(b, w, n) + ground
    if not ground.any():
        ground = ground.copy()
        ground[0] = max(diagonal[0], 1.0)
        diagonal = diagonal + ground
    diagonal = np.where(diagonal > 0, diagonal, 1.0)
    if n <= DENSE:
        m = np.diag(diagonal)
        np.add.at(m, (a, b), -w)
        np.add.at(m, (b, a), -w)
        return np.linalg.solve(m, right.T).T
    x = np.zeros_like(right)
    r, p, before = right.copy(), np.zeros_like(right), np.ones(2)
    stop = 1e-24 * np.maximum((right * right / diagonal).sum(axis=1), 1e-300)
    for _ in range(20 * n):
        z = r / diagonal
        rz = (r * z).sum(axis=1)
        if (rz <= stop).all():
            break
        p = z + p * (rz / before)[:, None]
        q = diagonal * p - np.stack([np.bincount(a, w * p[k, b], n) + np.bincount(b, w * p[k, a], n) for k in range(2)])
        step = np.where(rz > stop, rz / np.maximum((p * q).sum(axis=1), 1e-300), 0)[:, None]
        x, r, before = x + step * p, r - step * q, np.maximum(rz, 1e-300)
    return x


def _right(a: np.ndarray, b: np.ndarray, w: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(b, w * d[k], n) - np.bincount(a, w * d[k], n) for k in range(2)])


def reweighted(a: np.ndarray, b: np.ndarray, d: np.ndarray, ncc: np.ndarray, n: int, reweights: int, huber: float) -> np.ndarray:
    """Positions ``(2, n)`` of one component, node 0 at the origin."""
    base = np.maximum(ncc, LEAST_WEIGHT)
    w, x = base, np.zeros((2, n))
    for _ in range(reweights):
        x = solve(a, b, w, _right(a, b, w, d, n), np.zeros(n))
        far = np.hypot(*(x[:, b] - x[:, a] - d))
        w = base * np.where(far <= huber, 1.0, huber / np.maximum(far, 1e-9))
    return x - x[:, :1]


def _locally(rows: DataFrame, reweights: int, huber: float) -> DataFrame:
    """Positions of components ``(dataset, root, a, b, dx, dy, ncc)``, each whole in its task, one after another."""

    def one(rows: list[np.ndarray]) -> pa.RecordBatch:
        dataset, root, a, b, dx, dy, ncc = rows
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        x = reweighted(at[: len(a)], at[len(a) :], np.stack((dx, dy)), ncc, len(nodes), reweights, huber)
        columns = [np.full(len(nodes), dataset[0]), np.full(len(nodes), root[0]), nodes, *x]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dataset", "root", "node", "x", "y"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            cut = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            for i, j in zip([0, *cut], cut, strict=False):
                yield one([r[i:j] for r in rows])
            held = [r[cut[-1] if len(cut) else 0 :] for r in rows]
        if held is not None and len(held[0]):
            yield one(held)

    order = ["dataset", "root"]
    rows = rows.select("dataset", "root", "a", "b", "dx", "dy", "ncc").repartition(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(each, "dataset long, root long, node long, x double, y double")


_KEY = ["dataset", "root"]


def _preconditioned(state: DataFrame, inner: DataFrame, coarse: DataFrame) -> DataFrame:
    """``state`` with (zx, zy): its blocks solved for (rx, ry) with the links inside them, plus the coarse equation's answer for the block."""

    def block(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["dataset", "root", "node", "zx", "zy"])
        rows = rows.sort_values("node")
        at = lambda c: np.searchsorted(rows.node.to_numpy(), links[c].to_numpy())
        a, b, w = at("a"), at("b"), links["w"].to_numpy(float)
        ground = np.maximum(rows.total.to_numpy() - np.bincount(a, w, len(rows)) - np.bincount(b, w, len(rows)), 0)
        ground[ground < 1e-9 * rows.total.to_numpy()] = 0
        z = solve(a, b, w, rows[["rx", "ry"]].to_numpy().T, ground)
        return pd.DataFrame({"dataset": rows.dataset, "root": rows.root, "node": rows.node, "zx": z[0], "zy": z[1]})

    def ties(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["dataset", "root", "block", "cx", "cy"])
        rows = rows.sort_values("block")
        at = lambda c: np.searchsorted(rows.block.to_numpy(), links[c].to_numpy())
        z = solve(at("a"), at("b"), links["w"].to_numpy(float), rows[["rx", "ry"]].to_numpy().T, np.zeros(len(rows)))
        return pd.DataFrame({"dataset": rows.dataset, "root": rows.root, "block": rows.block, "cx": z[0], "cy": z[1]})

    keys = [*_KEY, "block"]
    inner, coarse = inner.toDF(*inner.columns), coarse.toDF(*coarse.columns)
    fine = state.groupBy(*keys).cogroup(inner.groupBy(*keys)).applyInPandas(block, "dataset long, root long, node long, zx double, zy double")
    sums = state.groupBy(*keys).agg(F.sum("rx").alias("rx"), F.sum("ry").alias("ry"))
    shift = sums.groupBy(*_KEY).cogroup(coarse.groupBy(*_KEY)).applyInPandas(ties, "dataset long, root long, block long, cx double, cy double")
    both = state.join(fine, [*_KEY, "node"]).join(shift, keys)
    return both.withColumns({"zx": F.col("zx") + F.col("cx"), "zy": F.col("zy") + F.col("cy")}).drop("cx", "cy")


def _dot(*pairs: tuple[str, str]):
    return F.sum(sum(F.col(f"{a}{c}") * F.col(f"{b}{c}") for a, b in pairs for c in "xy"))


def _gradients(rows: DataFrame, start: DataFrame, block: int, tolerance: float, steps: int) -> DataFrame:
    """Positions ``(dataset, root, node, x, y)`` that solve links ``(dataset, root, a, b, dx, dy, w)`` from positions ``start``."""
    number = lambda c: F.floor(F.col(c) / block)
    rows = rows.select(*_KEY, "a", "b", "w", "dx", "dy", number("a").alias("ba"), number("b").alias("bb"))
    one = rows.select(*_KEY, F.col("b").alias("u"), F.col("a").alias("node"), "w", F.col("dx").alias("ex"), F.col("dy").alias("ey"))
    two = rows.select(*_KEY, F.col("a").alias("u"), F.col("b").alias("node"), "w", (-F.col("dx")).alias("ex"), (-F.col("dy")).alias("ey"))
    around = checkpointed(one.unionByName(two))
    # fresh columns: what is cogrouped must not share any with the state
    inner = checkpointed(rows.where("ba = bb").groupBy(*_KEY, F.col("ba").alias("block"), "a", "b").agg(F.sum("w").alias("w")))
    coarse = checkpointed(rows.where("ba <> bb").groupBy(*_KEY, F.col("ba").alias("a"), F.col("bb").alias("b")).agg(F.sum("w").alias("w")))

    def pulled(state: DataFrame, x: str, offsets: bool) -> DataFrame:
        """(ax, ay) = the sum over a node's links of weight times the other end's value, with the link's offset or without."""
        met = around.join(state.select(*_KEY, "node", F.col(f"{x}x").alias("vx"), F.col(f"{x}y").alias("vy")), [*_KEY, "node"])
        value = lambda c: F.sum(F.col("w") * (F.col(f"v{c}") + F.col(f"e{c}") * int(offsets)))
        return met.groupBy(*_KEY, F.col("u").alias("node")).agg(value("x").alias("ax"), value("y").alias("ay"))

    total = around.groupBy(*_KEY, F.col("u").alias("node")).agg(F.sum("w").alias("total"))
    state = total.join(start.select(*_KEY, "node", F.col("x").alias("sx"), F.col("y").alias("sy")), [*_KEY, "node"], "left").na.fill(0.0, ["sx", "sy"])
    state = checkpointed(state.withColumn("block", number("node")))
    left = state.join(pulled(state, "s", True), [*_KEY, "node"])
    zero = F.lit(0.0)
    left = left.withColumns({"rx": F.col("ax") - F.col("total") * F.col("sx"), "ry": F.col("ay") - F.col("total") * F.col("sy"), "px": zero, "py": zero}).drop("ax", "ay")
    scalars = around.groupBy(*_KEY).agg(F.sum(F.col("w") * (F.col("ex") ** 2 + F.col("ey") ** 2)).alias("scale")).withColumn("before", F.lit(None).cast("double"))
    before: list[DataFrame] = []
    for _ in range(steps):
        # written and reread: a checkpoint's plan would keep what the optimizer infers of every round
        old, before = before, [state := saved(_preconditioned(left, inner, coarse), "solve")]
        scalars = saved(scalars.join(state.groupBy(*_KEY).agg(_dot(("r", "z")).alias("rz")), _KEY), "scalars")
        before.append(scalars)
        forget(*old)
        if scalars.where(F.col("rz") > tolerance**2 * F.col("scale")).isEmpty():
            break
        beta = F.coalesce(F.try_divide("rz", "before"), zero)
        state = state.join(scalars.select(*_KEY, "rz", beta.alias("beta")), _KEY)
        state = saved(state.withColumns({f"p{c}": F.col(f"z{c}") + F.col("beta") * F.col(f"p{c}") for c in "xy"}).drop("zx", "zy", "beta"), "solve")
        before.append(state)
        state = state.join(pulled(state, "p", False), [*_KEY, "node"])
        state = saved(state.withColumns({f"q{c}": F.col("total") * F.col(f"p{c}") - F.col(f"a{c}") for c in "xy"}).drop("ax", "ay"), "solve")
        before.append(state)
        alpha = state.groupBy(*_KEY, "rz").agg(_dot(("p", "q")).alias("pq")).select(*_KEY, F.coalesce(F.try_divide("rz", "pq"), zero).alias("alpha"))
        left = state.join(alpha, _KEY)
        left = left.withColumns({f"{k}{c}": F.col(f"{k}{c}") + sign * F.col("alpha") * F.col(f"{by}{c}") for k, sign, by in (("s", 1, "p"), ("r", -1, "q")) for c in "xy"}).drop("qx", "qy", "alpha", "rz")
        scalars = scalars.select(*_KEY, "scale", F.col("rz").alias("before"))
    return state.select(*_KEY, "node", F.col("sx").alias("x"), F.col("sy").alias("y"))


def _distances(rows: DataFrame, at: DataFrame) -> DataFrame:
    """Links ``(dataset, root, a, b, ...)`` with ``far``, how far they are from what they measured."""
    one = at.select(*_KEY, F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    two = at.select(*_KEY, F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    far = F.hypot(F.col("bx") - F.col("ax") - F.col("dx"), F.col("by") - F.col("ay") - F.col("dy"))
    return rows.join(one, [*_KEY, "a"]).join(two, [*_KEY, "b"]).withColumn("far", far).drop("ax", "ay", "bx", "by")


def _on_tables(rows: DataFrame, reweights: int, huber: float, block: int, tolerance: float, steps: int) -> DataFrame:
    base = F.greatest("ncc", F.lit(LEAST_WEIGHT))
    at = rows.select(*_KEY, F.col("a").alias("node"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).where("false")
    weighted = rows.withColumn("w", base)
    for k in range(reweights):
        at = saved(_gradients(weighted, at, block, tolerance, steps), "positions")
        if k < reweights - 1:
            far = _distances(rows, at)
            weighted = saved(far.withColumn("w", base * F.when(F.col("far") <= huber, 1.0).otherwise(huber / F.col("far"))).drop("far"), "weighted")
    origin = at.where("node = root").select(*_KEY, F.col("x").alias("ox"), F.col("y").alias("oy"))
    return at.join(origin, _KEY).select(*_KEY, "node", (F.col("x") - F.col("ox")).alias("x"), (F.col("y") - F.col("oy")).alias("y"))


def solved_layout(
    links: DataFrame, reweights: int = REWEIGHTS, huber: float = HUBER, most: float = MOST, rounds: int = ROUNDS, local_links: int = LOCAL_LINKS, block: int = BLOCK, tolerance: float = 1e-8, steps: int = 200
) -> tuple[DataFrame, DataFrame]:
    """``(dataset, node, component, x, y)`` of all ends of links ``(dataset, a, b, dx, dy, ncc)``, and the links that are kept.

    ``(dx, dy)`` is where b is from a. Component 0 is the dataset's largest (ties by the smallest node); its smallest node is
    at the origin, and a node that no kept link holds is one by itself at its origin. Links whose residual passes ``most``
    are dropped and the others solved again, at most ``rounds`` times. Nulls in a link's ends or numbers and self-links are
    ignored, repeated links count each; an empty table gives empty ones.
    """
    given = links.select("dataset", *[F.col(c).cast("long").alias(c) for c in "ab"], *[F.col(c).cast("double").alias(c) for c in ("dx", "dy", "ncc")]).na.drop().where("a <> b")
    active = given = saved(given.withColumn("dataset", F.col("dataset").cast("long")), "links")
    at = lambda c: F.struct("dataset", F.col(c).alias("node")).alias(c)

    def components(active: DataFrame) -> DataFrame:
        return connected_components(active.select(at("a"), at("b"))).select("node.dataset", "node.node", F.col("root.node").alias("root"))

    placed, stored = None, [given]
    for k in range(rounds):
        root = components(active)
        rows = active.select("dataset", "a", "b", "dx", "dy", "ncc").join(root.withColumnRenamed("node", "a"), ["dataset", "a"])
        rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(*_KEY))) if local_links else rows.withColumn("n", F.lit(1))
        rows = saved(rows, "rooted")
        placed = _locally(rows.where(F.col("n") <= local_links), reweights, huber)
        large = rows.where(F.col("n") > local_links)
        if not large.isEmpty():
            placed = placed.unionByName(_on_tables(large.drop("n"), reweights, huber, block, tolerance, steps))
        placed = saved(placed, "placed")
        active = saved(_distances(rows, placed).where(F.col("far") <= most).drop("n"), "active")
        stored += [rows, placed, active]
        if k == rounds - 1 or active.count() == rows.count():
            break
    nodes = given.select("dataset", F.explode(F.array("a", "b")).alias("node")).distinct()
    every = nodes.join(components(active), ["dataset", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    every = every.join(placed.drop("root"), ["dataset", "node"], "left").na.fill(0.0, ["x", "y"])
    origin = every.where("node = root").select("dataset", "root", F.col("x").alias("ox"), F.col("y").alias("oy"))
    sizes = every.groupBy("dataset", "root").agg(F.count("*").alias("n"))
    component = (F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("n"), "root")) - 1).cast("long")
    every = every.join(sizes.withColumn("component", component), _KEY).join(origin, _KEY)
    out = saved(every.select("dataset", "node", "component", (F.col("x") - F.col("ox")).alias("x"), (F.col("y") - F.col("oy")).alias("y")), "layout")
    kept = saved(active.select("dataset", "a", "b", "dx", "dy", "ncc", F.col("far").alias("residual")), "kept-links")
    forget(*stored)
    return out, kept
