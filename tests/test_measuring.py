"""Layouts, grids, pairs and blocks of pictures against plain Python and numpy."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from lamella.operators import blocks, graph, lattice, pairing, recut, solving

# layouts


def plain_layout(links, reweights):
    """Dense, one component at a time: ``{node: (x, y)}`` of links (a, b, dx, dy, ncc) that are all in one component."""
    nodes = sorted({n for link in links for n in link[:2]})
    at = {n: k for k, n in enumerate(nodes)}
    a, b = (np.array([at[link[k]] for link in links]) for k in (0, 1))
    d = np.array([link[2:4] for link in links])
    base = w = np.maximum([link[4] for link in links], 0.05)
    for _ in range(reweights):
        m = np.zeros((len(links), len(nodes)))
        m[np.arange(len(a)), a], m[np.arange(len(a)), b] = -1, 1
        x = np.linalg.lstsq(m * np.sqrt(w)[:, None], d * np.sqrt(w)[:, None], rcond=None)[0]
        far = np.hypot(*(x[b] - x[a] - d).T)
        w = base * np.where(far <= 3, 1, 3 / np.maximum(far, 1e-9))
    return {n: x[k] - x[0] for n, k in at.items()}


def noisy_links(rng, n, far, steps):
    place = [(rng.uniform(0, 3000), rng.uniform(0, 3000)) for _ in range(n)]
    return [(i, i + s, place[i + s][0] - place[i][0] + rng.gauss(0, far), place[i + s][1] - place[i][1] + rng.gauss(0, far), rng.choice([0.01, 0.4, 0.9])) for i in range(n) for s in steps if i + s < n]


LINK = "dataset long, a long, b long, dx double, dy double, ncc double"


def test_layout_in_tasks(spark):
    """Components of many datasets, a dataset that falls apart when its one bad bridge goes, nulls and self-links."""
    rng = random.Random(5)
    want, rows = {}, []
    for dataset in range(4):
        links = noisy_links(rng, 12 + dataset, 0.5, (1, 2, 5))
        want |= {(dataset, n): p for n, p in plain_layout(links, 12).items()}
        rows += [(dataset, *link) for link in links]
    rows += [(9, 1, 2, 5.0, 5.0, 0.9), (9, 2, 3, 5.0, 5.0, 0.9), (9, 1, 3, 90.0, 10.0, 0.9), (9, 7, 8, 1.0, 2.0, 0.5), (9, 4, 4, 1.0, 1.0, 0.5), (9, None, 4, 1.0, 1.0, 0.5), (None, 1, 4, 1.0, 1.0, 0.5)]
    layout, kept = solving.solved_layout(spark.createDataFrame(rows, LINK).repartition(5))
    got = {(r.dataset, r.node): r for r in layout.collect()}
    for key, (x, y) in want.items():
        assert got[key].component == 0 and math.hypot(got[key].x - x, got[key].y - y) < 1e-6
    assert {n: got[9, n].component for n in (7, 8)} == {7: got[9, 7].component, 8: got[9, 7].component} and set(got) - set(want) == {(9, n) for n in (1, 2, 3, 7, 8)}
    assert all(r.residual <= 15 for r in kept.collect())
    empty, none = solving.solved_layout(spark.createDataFrame([], LINK))
    assert empty.collect() == [] and none.collect() == []


def test_layout_on_tables(spark):
    """A component in blocks of eight nodes, solved by joins, is where the dense solution is."""
    links = noisy_links(random.Random(6), 26, 0.5, (1, 3, 11))
    layout, _ = solving.solved_layout(spark.createDataFrame([(0, *link) for link in links], LINK), reweights=2, rounds=1, local_links=0, block=8)
    want = plain_layout(links, 2)
    got = {r.node: (r.x, r.y) for r in layout.collect()}
    assert set(got) == set(want) and all(math.dist(got[n], want[n]) < 1e-3 for n in want)


def test_sparse_solution():
    """Conjugate gradients in a task, with and without ground, against the dense matrix."""
    rng = np.random.default_rng(3)
    n = 500
    a, b = np.concatenate((np.arange(n - 1), rng.integers(0, n, 900))), np.concatenate((np.arange(1, n), rng.integers(0, n, 900)))
    a, b = a[a != b], b[a != b]
    w = rng.uniform(0.05, 1, len(a))
    m = np.zeros((n, n))
    for i, j, x in zip(a, b, w, strict=True):
        m[i, i] += x
        m[j, j] += x
        m[i, j] -= x
        m[j, i] -= x
    right = m @ rng.normal(size=(n, 2))
    x = solving.solve(a, b, w, right.T, np.zeros(n))
    assert np.abs(m @ x.T - right).max() < 1e-6 and abs(x[:, 0]).max() < 1e-9
    ground = np.where(np.arange(n) % 50 == 0, 0.3, 0.0)
    assert np.abs((m + np.diag(ground)) @ solving.solve(a, b, w, right.T, ground).T - right).max() < 1e-6


# grids


def walked(pads, links):
    """Column and row of every pad by a walk along the links from each part's smallest pad."""
    beside = defaultdict(list)
    for a, b, c, r in links:
        beside[a].append((b, c, r))
        beside[b].append((a, -c, -r))
    out = {}
    for start in sorted(pads):
        if start in out:
            continue
        part, todo = {start: (0, 0)}, [start]
        while todo:
            a = todo.pop()
            for b, c, r in beside[a]:
                if b not in part:
                    part[b] = (part[a][0] + c, part[a][1] + r)
                    todo.append(b)
        c0, r0 = (min(p[k] for p in part.values()) for k in (0, 1))
        out |= {p: (start, len(part), c - c0 + 1, r - r0 + 1) for p, (c, r) in part.items()}
    return out


def test_indexed_pads(spark):
    """A turned, drifting grid with holes and pads off their place, against the walk and the planted cells."""
    rng = random.Random(9)
    along, down = (13.2, 1.1), (-1.0, 13.5)
    pads, cells = {}, {}
    for c in range(24):
        for r in range(18):
            if rng.random() < 0.15:
                continue
            k, wrong = rng.randrange(10**9), rng.random() < 0.05
            x, y = c * along[0] + r * down[0] + 0.02 * c * c, c * along[1] + r * down[1] + rng.uniform(-1, 1)
            pads[k], cells[k] = (x + 6 * wrong, y + 6 * wrong), None if wrong else (c, r)
    rows = [(m, k, x, y) for m in (1, 2) for k, (x, y) in pads.items()]
    data = spark.createDataFrame([*rows, rows[0], (1, None, 1.0, 1.0), (1, 5, None, 1.0)], "mosaic long, pad long, x double, y double").repartition(3)
    got = lattice.indexed_pads(data, along, down).collect()
    links = [(r.a, r.b, r.col, r.row) for r in lattice.pad_links(data.where("mosaic = 1").na.drop(), along, down).distinct().collect()]
    want = walked(set(pads), links)
    assert len(got) == 2 * len(pads) and all((r.part, r.n, r.col, r.row) == want[r.pad] and r.n_wrong == 0 for r in got)
    main = [r for r in got if r.n > 100 and r.mosaic == 1]
    off = {(r.col - cells[r.pad][0], r.row - cells[r.pad][1]) for r in main if cells[r.pad]}
    assert len(off) == 1 and len(main) >= sum(c is not None for c in cells.values()) - 3
    assert lattice.indexed_pads(data.limit(0), along, down).collect() == []


def test_contradicting_links(spark, monkeypatch):
    """Pads around a misfit close a cycle that doesn't add up: it is counted at its pads."""
    monkeypatch.setattr(lattice, "pad_links", lambda pads, *_: spark.createDataFrame([(1, 1, 2, 1, 0), (1, 2, 3, 1, 0), (1, 1, 3, 1, 0)], "mosaic long, a long, b long, col long, row long"))
    pads = spark.createDataFrame([(1, k, 0.0, 0.0) for k in (1, 2, 3)], "mosaic long, pad long, x double, y double")
    assert sum(r.n_wrong for r in lattice.indexed_pads(pads, (10.0, 0.0), (0.0, 10.0)).collect()) == 2


def unbroadcast(df):
    return "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_links_of_stored_pads(spark, tmp_path):
    """Pads and links in files look small: no join of pads, numbers of nodes or potentials is broadcast."""
    spark.range(300).selectExpr("1L AS mosaic", "id AS pad", "10D * (id % 20) AS x", "10D * floor(id / 20) AS y").write.parquet(f"{tmp_path}/pads")
    links = lattice.pad_links(spark.read.parquet(f"{tmp_path}/pads"), (10.0, 0.0), (0.0, 10.0))
    assert unbroadcast(links)
    links.selectExpr("struct(mosaic, a AS pad) AS a", "struct(mosaic, b AS pad) AS b", "-col AS col", "-row AS row").write.parquet(f"{tmp_path}/links")
    edges = spark.read.parquet(f"{tmp_path}/links")
    found = graph.connected_components(edges, steps=["col", "row"])
    wrong = graph.contradictions(edges, found, ["col", "row"])
    assert unbroadcast(found) and unbroadcast(wrong) and wrong.isEmpty()
    assert {(r.node.pad, r.root.pad, r.col, r.row) for r in found.collect()} == {(i, 0, i % 20, i // 20) for i in range(300)}


def test_filled_cells_of_stored_pads(spark, tmp_path):
    """Cells are many more than a file of indexed pads lets expect: they aren't broadcast."""
    spark.range(100).where("id <> 55").selectExpr("1L AS mosaic", "0L AS part", "id % 10 AS col", "floor(id / 10) AS row").write.parquet(f"{tmp_path}/indexed")
    got = lattice.filled_cells(spark.read.parquet(f"{tmp_path}/indexed"))
    assert unbroadcast(got)
    assert [tuple(r) for r in got.collect()] == [(1, 0, 5, 5, 4)]


def test_filled_cells(spark):
    rows = [(1, 7, c, r) for c in range(1, 5) for r in range(1, 4) if (c, r) not in ((2, 2), (4, 3))]
    got = lattice.filled_cells(spark.createDataFrame(rows, "mosaic long, part long, col long, row long")).collect()
    assert {(r.col, r.row, r.n_around) for r in got} == {(2, 2, 4), (4, 3, 2)}


# pictures


def as_blocks(spark, picture, side, missing=()):
    h, w = picture.shape
    rows = [(4, x // side, y // side, [float(v) for v in picture[y : y + side, x : x + side].ravel()]) for y in range(0, h, side) for x in range(0, w, side) if (x // side, y // side) not in missing]
    return spark.createDataFrame(rows, "grp long, bx long, by long, px array<double>").repartition(3)


@pytest.mark.parametrize(("side", "reach"), [(4, 1), (4, 3), (4, 6), (12, 3), (24, 5)])
def test_local_maxima(spark, side, reach):
    """The maxima of the whole picture, for any size of block, also where the rim is wider than a block."""
    rng = np.random.default_rng(side + reach)
    picture = np.round(rng.random((24, 24)), 2)
    missing = {(1, 0), (2, 2)} if side == 4 else set()
    seen = np.full(picture.shape, True)
    for bx, by in missing:
        seen[by * side : (by + 1) * side, bx * side : (bx + 1) * side] = False
    masked = np.where(seen, picture, -1)
    want = {(x, y) for y in range(24) for x in range(24) if seen[y, x] and picture[y, x] >= 0.5 and picture[y, x] >= masked[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1].max()}
    got = blocks.local_maxima(as_blocks(spark, picture, side, missing), side, reach, 0.5).collect()
    assert {(r.x, r.y) for r in got} == want and len(got) == len(want) and all(r.value == picture[r.y, r.x] for r in got)


@pytest.mark.parametrize("side", [3, 6, 12])
def test_blur(spark, side):
    picture, sigma = np.random.default_rng(1).random((24, 36)), 1.5
    reach = 6
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(picture, reach, mode="reflect")
    want = np.zeros_like(picture)
    for i, a in enumerate(weight):
        for j, b in enumerate(weight):
            want += a * b * padded[i : i + 24, j : j + 36] / weight.sum() ** 2
    for r in blocks.blurred(as_blocks(spark, picture, side), side, sigma, (36, 24)).collect():
        part = want[r.by * side : (r.by + 1) * side, r.bx * side : (r.bx + 1) * side]
        assert np.abs(np.array(r.px).reshape(side, side) - part).max() < 1e-9


@pytest.mark.parametrize("held", [4 << 20, 70, 1])
def test_frame_statistics(spark, held):
    """The same numbers however many pixels a piece has."""
    rng = np.random.default_rng(2)
    frames = {g: rng.random((n, 20)) for g, n in ((1, 9), (2, 4), (3, 1))}
    rows = [(g, [float(v) for v in f]) for g, fs in frames.items() for f in fs] + [(1, None), (1, [1.0])]
    got = blocks.frame_statistics(spark.createDataFrame(rows, "grp long, px array<double>").repartition(4), 20, held).collect()
    for g, fs in frames.items():
        mine = sorted((r for r in got if r.grp == g), key=lambda r: r.first)
        for name, want in (("median", np.median(fs, axis=0)), ("largest", fs.max(axis=0)), ("deviation", fs.std(axis=0))):
            assert np.allclose([v for r in mine for v in r[name]], want)
    assert held > 100 or len(got) > 3


def test_median_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 40)
    rng = np.random.default_rng(7)
    frames = [(1, int(rng.integers(0, 20)), int(rng.integers(0, 9)), [float(v) for v in rng.random(36)]) for _ in range(30)]
    over = defaultdict(list)
    for _, x, y, px in frames:
        for k, v in enumerate(px):
            over[x + k % 6, y + k // 6].append(v)
    for block in (5, 8, 32):
        got = {}
        for r in blocks.median_blocks(spark.createDataFrame(frames, "grp long, x long, y long, px array<double>").repartition(3), 6, block).collect():
            got |= {(r.bx * block + k % block, r.by * block + k // block): v for k, v in enumerate(r.px) if not math.isnan(v)}
        assert set(got) == set(over) and all(abs(got[p] - np.median(v)) < 1e-12 for p, v in over.items())


def test_windows(spark):
    rng = np.random.default_rng(4)
    picture = (rng.random((30, 40)) < 0.6).astype(float)
    picture[:10, :15] = 0
    data = as_blocks(spark, picture, 5, {(7, 5), (0, 0)})
    seen = picture.copy()
    seen[25:30, 35:40] = seen[:5, :5] = 0
    got = {(r.bx, r.by): r.total for r in blocks.window_sums(data, 4, 1).collect()}
    assert got == {(x, y): seen[5 * y : 5 * y + 20, 5 * x : 5 * x + 20].sum() for x in range(5) for y in range(3)}
    walk, every = [], sorted(((seen[5 * y : 5 * y + 20, 5 * x : 5 * x + 20].mean(), y, x) for x in range(0, 5, 2) for y in range(0, 3, 2)), reverse=True)
    for share, y, x in every:
        if share > 0.35 and all(abs(y - ty) >= 2 or abs(x - tx) >= 2 for _, ty, tx in walk):
            walk.append((share, y, x))
    rows = sorted(blocks.covered_windows(data, 5, 4).collect(), key=lambda r: r.place)
    assert [(round(r.share, 9), r.by, r.bx) for r in rows] == [(round(s, 9), y, x) for s, y, x in walk[:5]]


# pairs and points


@pytest.mark.parametrize(("reach", "round_reach", "last_first"), [(3, False, False), (5, True, False), (4, False, True), (40, False, False)])
def test_kept_apart(spark, reach, round_reach, last_first):
    rng = random.Random(reach)
    points = [(g, rng.randrange(60), rng.randrange(60), rng.randrange(12) / 4) for g in (1, 2) for _ in range(250)]
    points = [*{p[:3]: p for p in points}.values()]
    want, sign = [], -1 if last_first else 1
    for g, x, y, s in sorted(points, key=lambda p: (p[0], -p[3], sign * p[2], sign * p[1])):
        near = (lambda u, v: (u - x) ** 2 + (v - y) ** 2 <= reach**2) if round_reach else (lambda u, v: abs(u - x) < reach and abs(v - y) < reach)  # noqa: B023
        if not any(h == g and near(u, v) for h, u, v, _ in want):
            want.append((g, x, y, s))
    rows = spark.createDataFrame(points + points[:3], "grp long, x long, y long, score double").repartition(3)
    assert sorted(tuple(r) for r in pairing.kept_apart(rows, reach, last_first, round_reach).collect()) == sorted(want)
    assert pairing.kept_apart(rows.limit(0), reach).collect() == []


def test_measured_pairs(spark):
    """Windows of one picture find how they lie to each other, in groups of any size; a flat tile can't be measured."""
    rng = np.random.default_rng(8)
    picture = rng.random((40, 40))
    places = [(int(x), int(y)) for x, y in rng.integers(0, 4, (9, 2)) * 2]
    tiles = [(3, 10 * k, [float(v) for v in picture[y : y + 12, x : x + 12].ravel()]) for k, (x, y) in enumerate(places)] + [(3, 95, [1.0] * 144), (4, 1, [2.0] * 144), (3, 96, [1.0]), (3, 97, None)]
    for group in (2, 4, 16):
        got = pairing.measured_pairs(spark.createDataFrame(tiles, "dataset long, trial long, px array<double>").repartition(4), 12, (-6, -4, -2, 0, 2, 4, 6), 30, group).collect()
        assert len(got) == 45 and len({(r.a, r.b) for r in got}) == 45
        for r in got:
            if r.b == 95:
                assert r.ncc is None and r.dx is None and r.moved is None
            else:
                (ax, ay), (bx, by) = places[r.a // 10], places[r.b // 10]
                assert (r.dx, r.dy) == (bx - ax, by - ay) and r.ncc > 0.999 and r.moved == ((bx, by) != (ax, ay))


# runs


def test_measured_pairs_of_many_tiles(spark):
    """Small tiles meet in large groups, so each travels once for each 256 of its dataset; what is measured is the same as in groups of 16."""
    rng = np.random.default_rng(4)
    tiles = [(1, t, [0.5] * 64 if t % 50 == 7 else rng.integers(0, 3, 64).astype(float).tolist()) for t in range(300)]
    data = spark.createDataFrame(tiles, "dataset long, trial long, px array<double>").repartition(3)
    assert pairing.meetings(data, 8).count() == 2 * 300
    assert pairing.meetings(data, 512).count() == 19 * 300
    measured = lambda group: sorted(tuple(r) for r in pairing.measured_pairs(data, 8, (-4, -2, 0, 2, 4), 16, group).collect())
    got = measured(None)
    assert len(got) == 300 * 299 // 2 and sum(r[5] is None for r in got) == 6 * 294 + 15 and got == measured(16)


def test_jumps():
    """Planted jumps are found where they are; a lone wrong anchor cuts nothing, also as the first or the last of a run."""
    rng = np.random.default_rng(11)
    base = rng.normal(0, 1, (30, 2))
    planted = base.copy()
    planted[9:] += (60, 0)
    planted[21:] += (0, -45)
    assert recut.jumps(planted) == ([9, 21], [])
    for lone in (0, 5, 29):
        wrong = base.copy()
        wrong[lone] += 300
        assert recut.jumps(wrong) == ([], [lone])
    short = np.array([[0.0, 0], [0, 0], [50, 0], [50, 0]])
    assert recut.jumps(short) == ([2], []) and recut.jumps(short[:3]) == ([], [2]) and recut.jumps(short[:0]) == ([], [])


def test_recut_runs(spark):
    rows = [(d, r, t, float(t), 0.0, None if t % 7 == 3 else t + (80.0 if r == 1 and t >= 12 else 0.0), 0.0) for d in (1, 2) for r in (0, 1) for t in range(20)] + [(1, 0, 99, None, 0.0, 1.0, 1.0)]
    got = recut.recut_runs(spark.createDataFrame(rows, "dataset long, run long, trial long, lx double, ly double, ax double, ay double").repartition(4)).collect()
    assert len(got) == 80 and all(x.part == int(x.run == 1 and x.trial >= 12) and not x.outlier for x in got)
