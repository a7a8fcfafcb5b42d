"""Near-duplicate vectors: a range join per subspace block, then exact verification."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from munim.llm.support import components, cut, number_rows, ship

ship(__name__)

#: Dimensions of a block, and how many of them form the grid of its range join.
BLOCK, GRID = 8, 2
#: Rows of one tile; a task compares two tiles.
TILE = 16_384
#: Rows compared at once inside a task.
STRIP = 256
#: Slack on squared distances of the filter, far above its rounding errors.
SLACK = 1e-5


def usable(v: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    return F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int, least: float) -> list[tuple[slice, float]]:
    """Blocks and their squared-distance budgets, in proportion to their dimensions.

    Unit vectors with cosine >= ``least`` differ by a squared distance of at most 2 - 2 least;
    in at least one block they differ by at most the block's share of it.
    """
    whole = 2.0 - 2.0 * least
    cuts = list(range(0, dims, BLOCK)) + [dims]
    return [(slice(a, b), whole * (b - a) / dims) for a, b in itertools.pairwise(cuts)]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe for very large and very small components."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def visits(block: np.ndarray, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, grid cells, at home) of rows in their own cell and in cells in their reach.

    Cells are twice as wide as the radius, so a row reaches at most one neighbour per grid
    dimension.  Of two cells, the rows of the larger visit the smaller one.
    """
    radius = np.sqrt(budget + SLACK)
    y = block[:, :GRID]
    home = np.floor(y / (2 * radius)).astype(np.int64)
    yield np.arange(len(y)), home, np.ones(len(y), dtype=bool)
    for step in itertools.product((-1, 0, 1), repeat=y.shape[1]):
        step = np.array(step)
        if tuple(step) >= (0,) * len(step):  # only to smaller cells
            continue
        low, high = home * 2 * radius, (home + 1) * 2 * radius
        gap = np.where(step < 0, y - low, np.where(step > 0, high - y, 0.0))
        near = np.flatnonzero((gap * gap).sum(axis=1) <= budget + SLACK)
        if len(near):
            yield near, home[near] + step, np.zeros(len(near), dtype=bool)


def links(vectors: DataFrame, dims: int, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of rows (v, vec) with cosine >= ``least`` in double precision.

    Every block is range-joined on a grid over its first rotated coordinates: rows meet in cells,
    are filtered by the block's squared distance, and survivors are verified over all dimensions
    at once, so only links leave a task.  The number of cells is bounded by the geometry of the
    unit sphere; cells with many rows are split into tiles and joined tile by tile.
    """
    turn = rotation(dims)
    plan = blocks_of(dims, least)
    kind = "<f4" if dict(vectors.dtypes)["vec"] == "array<float>" else "<f8"

    def matrix(values: pd.Series) -> np.ndarray:
        out = np.zeros((len(values), dims))
        for k, v in enumerate(values):
            out[k, :len(v)] = v
        return out

    def cells(y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for i, (part, budget) in enumerate(plan):
            for rows, cell, home in visits(y[:, part], budget):
                code = np.zeros(len(rows), dtype=np.int64)
                for k in range(cell.shape[1]):  # coordinates of unit vectors: few cells
                    code = code * 4096 + (cell[:, k] + 2048)
                yield i, rows, code, home

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                for i, _, code, home in cells(unit(matrix(batch["vec"])) @ turn):
                    found, n = np.unique(code, return_counts=True)
                    yield pd.DataFrame({"block": i, "cell": found, "home": home[0], "n": n})

    sizes = {(r["block"], r["cell"], r["home"]): -(-r["n"] // TILE)
             for r in vectors.mapInPandas(count, "block int, cell long, home boolean, n long")
             .groupBy("block", "cell", "home").agg(F.sum("n").alias("n")).collect()}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch["vec"])
            raw = x.astype(kind)
            ids = batch["v"].to_numpy()
            for i, rows, code, home in cells(unit(x) @ turn):
                at_home = bool(home[0])
                for cell in np.unique(code):
                    mine = rows[code == cell]
                    homes = sizes.get((i, cell, True), 0)
                    guests = sizes.get((i, cell, False), 0)
                    # v is a running number: its remainder deals rows evenly to tiles.
                    tile = ids[mine] % max(homes if at_home else guests, 1)
                    out = []
                    for t in np.unique(tile):
                        rows_t = mine[tile == t]
                        place = int(t) if at_home else homes + int(t)
                        pairs = [(place, k, True) for k in range(place, homes + guests)] if at_home else []
                        pairs += [(h, place, False) for h in range(min(place, homes))]
                        data = [raw[r].tobytes() for r in rows_t]
                        out += [pd.DataFrame({"block": i, "cell": cell, "h": h, "k": k, "first": f,
                                              "v": ids[rows_t], "data": data}) for h, k, f in pairs]
                    if out:
                        yield pd.concat(out)

    starts = np.array([p.start for p, _ in plan])
    budgets = np.array([b for _, b in plan])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        block = int(group["block"].iat[0])
        part, budget = plan[block]

        def side(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            x = np.frombuffer(b"".join(rows["data"]), dtype=kind).reshape(len(rows), dims)
            return rows["v"].to_numpy(), unit(x.astype(np.float64))

        va, a = side(group[group["first"]])
        same = group["h"].iat[0] == group["k"].iat[0]
        vb, b = (va, a) if same else side(group[~group["first"]])
        out = [np.zeros((0, 2), dtype=np.int64)]
        if len(va) and len(vb):
            ya, yb = (m @ turn[:, part] for m in (a, b))
            # One product gives the squared distances: |x|^2 - 2 x y + |y|^2.
            one = lambda m: np.ones((len(m), 1))
            square = lambda m: (m * m).sum(axis=1, keepdims=True)
            left = np.hstack([-2 * ya, square(ya), one(ya)]).astype(np.float32)
            right = np.hstack([yb, one(yb), square(yb)]).astype(np.float32)
            for s in range(0, len(va), STRIP):
                low = s if same else 0  # of a tile with itself, the upper triangle
                near = left[s:s + STRIP] @ right[low:].T <= budget + SLACK
                i, j = np.divmod(np.flatnonzero(near), near.shape[1])
                i, j = i + s, j + low
                if same:
                    i, j = i[i < j], j[i < j]
                for c in range(0, len(i), 65_536):
                    p, q = a[i[c:c + 65_536]], b[j[c:c + 65_536]]
                    ok = (p * q).sum(axis=1) >= least
                    # An earlier block that surely finds the pair reports it.
                    diff = ((p[ok] - q[ok]) @ turn) ** 2
                    sure = np.add.reduceat(diff, starts, axis=1) <= budgets
                    new = ~sure[:, :block].any(axis=1)
                    out.append(np.stack([va[i[c:c + 65_536][ok][new]],
                                         vb[j[c:c + 65_536][ok][new]]], axis=1))
        found = np.sort(np.concatenate(out), axis=1)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    dealt = vectors.mapInPandas(
        deal, "block int, cell long, h int, k int, first boolean, v long, data binary")
    return dealt.groupBy("block", "cell", "h", "k").applyInPandas(
        compare, "a long, b long").distinct()


def near_vectors(
    rows: DataFrame, *, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id, kept.

    Two vectors are linked if their cosine in double precision is at least ``least``.  Vectors
    that are null, zero, or hold null or non-finite components link with nothing; shorter
    vectors are filled up with zeros.  Repeated vectors are linked with each other and joined
    once: their links are counted, not listed.  component_id is the smallest id reachable by
    links, its own included, and kept tells whether that is the row's own id.  A null id takes
    part but is never smallest; a component of null ids alone has a null component_id and is
    kept.  Other columns are ignored.  An empty table gives an empty result.
    """
    vec = rows.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("vec")).withColumn(
        "_ok", usable(F.col("vec"))).withColumns({
            "_h1": F.xxhash64("vec"), "_h2": F.xxhash64(F.lit(1), "vec")})
    classes = cut(vec.where("_ok").groupBy("_h1", "_h2").agg(
        F.min("_id").alias("_least"), F.count("*").alias("_n"), F.first("vec").alias("vec")))
    n, dims = classes.agg(F.count("*"), F.max(F.size("vec"))).first()
    flat = cut(number_rows(classes.withColumn("_all", F.lit(1)), "_all", ["_h1", "_h2"], "v", n or 0))
    pairs = cut(links(flat.select("v", "vec"), dims, least)) if n else None
    if pairs is None:
        return vec.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                          F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    found = components(pairs)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(flat.select(F.col("v").alias("b"), "_n"), "b").groupBy(
        F.col("a").alias("v")).agg(F.sum("_n").alias("_links"))
    of = flat.drop("vec", "_all").join(found, "v", "left").join(counts, "v", "left").withColumn(
        "component", F.coalesce("component", "v"))
    tops = of.groupBy("component").agg(F.min("_least").alias("_top"))
    done = of.join(tops, "component").select(
        "_h1", "_h2", "_top", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links"))
    top = F.when(F.col("_ok"), F.col("_top")).otherwise(F.col("_id"))
    return vec.drop("vec").join(done, ["_h1", "_h2"], "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("_ok"), F.col("_links")).otherwise(0).cast("long").alias("n_links"),
        top.alias("component_id"), F.col("_id").eqNullSafe(top).alias("kept"))
