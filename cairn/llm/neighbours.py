"""Approximate nearest neighbours: stable projections to a few dimensions, kd-trees over them, chi-square stopping."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, id_columns
from .vector_codes import finite

#: Neighbours of a query, and that queries are rows whose id it divides.
NEAREST, EVERY = 20, 20
#: Dimensions of the projections (even), and the probability that the stopping test asks for.
DIMENSIONS, SURE = 12, 0.95
#: Points of a tree's leaf; rows whose projections the cells are fitted on; most cells; least and most points of a task.
LEAF, SAMPLE, CELLS, LEAST, MOST = 64, 65_536, 4096, 4096, 262_144
SEED = 12


def chi_square(x: float, m: int) -> float:
    """P(chi-square with m degrees of freedom <= x), m even."""
    half = x / 2
    term = total = math.exp(-half)
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1.0 - total


def quantile(p: float, m: int) -> float:
    low, high = 0.0, 10.0 * m + 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def projection(dimensions: int, m: int) -> np.ndarray:
    """Gaussian (2-stable) directions: a squared projected distance over the squared distance is chi-square distributed."""
    return np.random.default_rng(SEED).standard_normal((dimensions, m))


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the components' order."""
    return np.cumsum(x * q, axis=1)[:, -1]


class Tree:
    """A kd-tree of points: median splits of the widest side down to leaves, each with the box of its points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        pieces, leaves = [np.arange(len(points))], []
        while pieces:
            own = pieces.pop()
            if len(own) <= leaf:
                leaves.append(own)
                continue
            side = int(np.argmax(np.ptp(points[own], axis=0)))
            order = own[np.argsort(points[own, side], kind="stable")]
            pieces += [order[len(own) // 2 :], order[: len(own) // 2]]
        self.points = points
        self.order = np.concatenate(leaves)
        self.starts = np.cumsum([0, *map(len, leaves)])
        self.low = np.stack([points[x].min(0) for x in leaves])
        self.high = np.stack([points[x].max(0) for x in leaves])

    def incremental(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Leaves by the least projected squared distance that a point there can have, a few more at each step: that
        distance of the nearest leaf, the points' numbers, and their projected squared distances."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0.0)
        near = (gap * gap).sum(1)
        order = np.argsort(near, kind="stable")
        at, step = 0, 1
        while at < len(order):
            taken = order[at : at + step]
            own = np.concatenate([self.order[self.starts[x] : self.starts[x + 1]] for x in taken])
            yield float(near[order[at]]), own, ((self.points[own] - q) ** 2).sum(1)
            at, step = at + step, 2 * step


def search(tree: Tree, x: np.ndarray, weights: np.ndarray, longest: float, q: np.ndarray, projected: np.ndarray, least: float, wanted: int, reach: float) -> np.ndarray:
    """Numbers of the points to keep for a query: all verified ones that can be among the wanted nearest, ties included.

    weights: rows that each point stands for. Points are verified (full inner products) in order of projected distance
    until the test holds: a point as near as the wanted-th so far would have been seen by now with the asked
    probability. least: a score that the wanted nearest have at least, from elsewhere.
    """
    size = float(np.sqrt(q @ q))
    slack = 1e-12 * size * longest
    found, scores = np.zeros(0, np.int64), np.zeros(0)

    def radius() -> float:
        """Projected squared distance at which the test holds, as unit vectors have the squared distance 2 - 2 cos."""
        return reach * max(0.0, 2.0 - 2.0 * (least - slack) / (size * longest)) if least > -np.inf else np.inf

    limit = radius()
    for nearest, own, distances in tree.incremental(projected):
        if nearest > limit:
            break
        own = own[distances <= limit]
        found, scores = np.concatenate([found, own]), np.concatenate([scores, x[own] @ q])
        order = np.argsort(-scores, kind="stable")
        total = np.cumsum(weights[found[order]])
        kth = int(np.searchsorted(total, wanted))
        if kth < len(order):
            least = max(least, scores[order[kth]])
            limit = radius()
        keep = scores >= least - slack
        found, scores = found[keep], scores[keep]
    return found


class Cells:
    """Boxes of one kd-tree over projections, by splits: rows of (side, cut, child below, child above) or leaf numbers."""

    def __init__(self, sample: np.ndarray, size: float, most: float, first: int):
        self.splits: list[tuple[int, float, int, int]] = []
        self.n = 0
        self.first = first
        self.root = self._grow(sample, size, most)

    def _grow(self, points: np.ndarray, size: float, most: float) -> int:
        """A node's number, or -1 - a cell's."""
        if size > most and len(points) >= 8:
            side = int(np.argmax(np.ptp(points, axis=0)))
            cut = float(np.median(points[:, side]))
            below = points[:, side] < cut
            if below.any():
                at = len(self.splits)
                self.splits.append((side, cut, 0, 0))
                share = below.mean()
                self.splits[at] = (side, cut, self._grow(points[below], size * share, most), self._grow(points[~below], size * (1 - share), most))
                return at
        self.n += 1
        return -1 - (self.first + self.n - 1)

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out[own] = -1 - node
            elif len(own):
                side, cut, below, above = self.splits[node]
                is_below = points[own, side] < cut
                todo += [(below, own[is_below]), (above, own[~is_below])]
        return out


def matrix(column: pd.Series, width: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), width)


def bands_of(norms: np.ndarray) -> np.ndarray:
    """Bands of lengths, each up to the square root of 2 wide, with length 1 amid one."""
    return np.floor(2 * np.log2(norms) + 0.5).astype(np.int64)


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(v, ids): each vector once, with its least ids as (e, k), as many as asked for; more of them can't be among the nearest.

    A hot vector's rows are cut down by each task before they are dealt.
    """
    order = Window.partitionBy("v").orderBy("e", "k")
    least = rows.select("v", "e", "k").distinct().withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most)
    return least.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("e", "k"))).alias("ids"))


def nearest_neighbours(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, every: int = EVERY, m: int = DIMENSIONS, sure: float = SURE, sample: int = SAMPLE, least_points: int = LEAST, most_points: int = MOST
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id `every` divides, its nearest of all others by inner product.

    Vectors are scaled to the longest of their band of lengths and get one more component that makes them unit vectors,
    so the largest inner product is the least distance. Cells of the projected space (fitted on a bounded sample) are
    dealt to tasks; a task builds a kd-tree of its cell and verifies incremental projected neighbours by full inner
    products until the chi-square test holds. A query searches its own cell first; what it finds there bounds which
    other cells it goes to, by the same test on the cells' boxes. Larger cells are cut into pieces by hash and more
    queries into blocks, so no task's size grows with the table.

    Each vector is searched for, and as a query, once, however many rows have it. Rows of the query's id aren't among its
    neighbours; rows of one id and vector count once; of an id with several vectors each is searched for. Null ids are
    no queries, and come last in ties. Vectors that are null, all zero, or hold a component that is null or not finite
    take no part; missing components of shorter ones count as 0. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    store = Store(spark, "nearest")
    wanted = nearest + 1  # the query's own row may be among them
    reach = quantile(sure, m)
    usable = finite("v") & F.exists("v", lambda x: x != 0)
    rows = vectors.select(*id_columns(F.col(vec_id)), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")).filter(usable)
    asks = ~F.col("e") & (F.col("k") % every == 0)
    width = rows.agg(F.max(F.size("v"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    directions = projection(width + 1, m)
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))
    classes = store.keep(distinct_vectors(rows.withColumn("v", padded), wanted))

    def whole(values: pd.Series) -> np.ndarray:
        return np.array(values.tolist(), np.float64).reshape(len(values), width)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            norms = np.sqrt((whole(batch["v"]) ** 2).sum(1))
            yield pd.DataFrame({"band": bands_of(norms), "norm": norms}).groupby("band", as_index=False).agg(longest=("norm", "max"), n=("norm", "size"))

    bands = classes.select("v").mapInPandas(measured, "band long, longest double, n long").groupBy("band").agg(F.max("longest").alias("longest"), F.sum("n").alias("n")).orderBy("band").collect()
    longest = {r.band: r.longest for r in bands}  # one number for each band of lengths
    n_points = sum(r.n for r in bands)

    def projected(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
        unit = x / scale[:, None]
        rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(1)))
        return unit @ directions[:-1] + rest[:, None] * directions[-1]

    def points_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        band = bands_of(np.sqrt((x * x).sum(1)))
        return band, projected(x, np.array([longest[b] for b in band.tolist()]))

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            band, p = points_of(whole(batch["v"]))
            yield pd.DataFrame({"band": band, "p": list(p)})

    share = min(1.0, sample / max(1, n_points))
    some = classes.select("v").filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * sample)
    fitted = some.mapInPandas(sampled, "band long, p array<double>").collect()
    target = min(most_points, max(least_points, n_points / CELLS))
    cells: dict[int, Cells] = {}
    n_cells = 0
    for r in bands:
        own = np.array([x.p for x in fitted if x.band == r.band], np.float64).reshape(-1, m)
        cells[r.band] = Cells(own, r.n, max(target, n_points / CELLS), n_cells)
        n_cells += cells[r.band].n
    band_of_cell = np.concatenate([np.full(cells[r.band].n, r.band) for r in bands])
    home_band = max(bands, key=lambda r: r.n).band

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = whole(batch["v"])
            band, p = points_of(x)
            cell = np.zeros(len(x), np.int64)
            for b in np.unique(band):
                cell[band == b] = cells[b].of(p[band == b])
            yield pd.DataFrame({"cell": cell, "x": [r.tobytes() for r in x], "p": [r.tobytes() for r in p], "pa": list(p), "ids": batch["ids"], "h": batch["h"]})

    struct = "array<struct<e: boolean, k: long>>"
    with_places = classes.select("v", "ids", F.xxhash64("v").alias("h")).mapInPandas(placed, f"cell long, x binary, p binary, pa array<double>, ids {struct}, h long")
    points = store.keep(with_places)
    sides = [f(F.col("pa")[i]).alias(f"{f.__name__}{i}") for i in range(m) for f in (F.min, F.max)]
    boxes = points.groupBy("cell").agg(F.count("*").alias("n"), *sides).collect()  # at most CELLS and one a band
    low, high, sizes = np.full((n_cells, m), np.inf), np.full((n_cells, m), -np.inf), np.zeros(n_cells, np.int64)
    for r in boxes:
        low[r.cell], high[r.cell], sizes[r.cell] = [r[f"min{i}"] for i in range(m)], [r[f"max{i}"] for i in range(m)], r.n
    pieces = -(-sizes // most_points)
    scale_of_cell = np.array([longest[b] for b in band_of_cell.tolist()])

    def prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = whole(batch["v"])
            p = projected(x, np.sqrt((x * x).sum(1)))
            cell = cells[home_band].of(p)
            yield pd.DataFrame({"q": batch["q"], "d": batch["d"], "x": [r.tobytes() for r in x], "p": [r.tobytes() for r in p], "cell": cell})

    asked = rows.filter(asks).withColumn("v", padded).groupBy("v").agg(F.min("k").alias("q"))
    asked = asked.withColumn("d", F.row_number().over(Window.partitionBy("q").orderBy("v")))
    asked = store.keep(asked)
    queries = store.keep(asked.mapInPandas(prepared, "q long, d int, x binary, p binary, cell long"))

    def visits(df: DataFrame, home: bool) -> DataFrame:
        """(cell, piece, q, d, x, p, least): the pieces of cells that each query searches, which the test doesn't exclude."""

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole_batch in batches:
                for start in range(0, len(whole_batch), 256):
                    batch = whole_batch.iloc[start : start + 256].reset_index(drop=True)
                    x, p, least = matrix(batch["x"], width), matrix(batch["p"], m), batch["least"].to_numpy(np.float64)
                    length = np.sqrt((x * x).sum(1))
                    at, cell = [], []
                    for i in range(len(batch)):
                        if home:
                            mine = np.array([batch["cell"][i]])
                        else:
                            gap = np.maximum(np.maximum(low - p[i], p[i] - high), 0.0)
                            far = np.inf if least[i] == -np.inf else reach * np.maximum(0.0, 2.0 - 2.0 * (least[i] / length[i] - 1e-12 * scale_of_cell) / scale_of_cell)
                            mine = np.flatnonzero(((gap * gap).sum(1) <= far) & (sizes > 0))
                        at.append(np.repeat(i, pieces[mine].sum()))
                        cell.append(np.stack([np.repeat(mine, pieces[mine]), np.concatenate([np.arange(c) for c in pieces[mine]] or [np.zeros(0, np.int64)])], 1))
                    at, cell = np.concatenate(at), np.concatenate(cell)
                    if not home:
                        other = (cell[:, 0] != batch["cell"].to_numpy()[at]) | (cell[:, 1] > 0)
                        at, cell = at[other], cell[other]
                    elif len(at):
                        first = cell[:, 1] == 0
                        at, cell = at[first], cell[first]
                    out = batch[["q", "d", "x", "p", "least"]].iloc[at].reset_index(drop=True)
                    yield out.assign(cell=cell[:, 0], piece=cell[:, 1])[["cell", "piece", "q", "d", "x", "p", "least"]]

        return df.select("q", "d", "x", "p", "cell", "least").mapInPandas(scan, "cell long, piece long, q long, d int, x binary, p binary, least double")

    def searched(df: DataFrame) -> DataFrame:
        """(q, d, score, e, k): what the visited pieces have for each query."""
        counts = {(r.cell, r.piece): r.n for r in df.groupBy("cell", "piece").agg(F.count("*").alias("n")).collect()}
        pairs = [(c, p, -(-n // most_points)) for (c, p), n in counts.items()]
        blocks = spark.createDataFrame(pairs, "cell long, piece long, blocks long")  # a row for each piece
        n_pieces = F.element_at(F.lit([max(1, int(n)) for n in pieces]), (F.col("cell") + 1).cast("int"))
        theirs = points.select("cell", "x", "p", "ids", F.pmod("h", n_pieces).cast("long").alias("piece")).join(F.broadcast(blocks), ["cell", "piece"])
        theirs = theirs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        mine = df.join(F.broadcast(blocks), ["cell", "piece"]).withColumn("block", F.pmod(F.xxhash64("q", "d"), F.col("blocks")))

        def of_piece(ours: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
            if not len(ours) or not len(asking):
                return pd.DataFrame({"q": [], "d": [], "score": [], "e": [], "k": []})
            x, tree = matrix(ours["x"], width), Tree(matrix(ours["p"], m))
            ids = ours["ids"].tolist()
            weights = np.array([len(r) for r in ids])
            scale = scale_of_cell[int(ours["cell"].iloc[0])]
            out = []
            for q, d, qx, qp, least in zip(asking["q"], asking["d"], matrix(asking["x"], width), matrix(asking["p"], m), asking["least"], strict=True):
                found = search(tree, x, weights, scale, qx, qp, least, wanted, reach)
                for i, score in zip(found.tolist(), exact_scores(x[found], qx).tolist(), strict=True) if len(found) else ():
                    out += [(q, d, score, r["e"], r["k"]) for r in ids[i]]
            return pd.DataFrame(out, columns=["q", "d", "score", "e", "k"])

        key = ["cell", "piece", "block"]
        return theirs.drop("blocks").groupBy(*key).cogroup(mine.drop("blocks").groupBy(*key)).applyInPandas(of_piece, "q long, d int, score double, e boolean, k long")

    best = Window.partitionBy("q", "d").orderBy(F.col("score").desc(), "e", "k")
    top = lambda df: df.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= wanted).drop("__n")
    at_home = store.keep(top(searched(store.keep(visits(queries.withColumn("least", F.lit(-math.inf)), True)))))
    bounds = at_home.groupBy("q", "d").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    known = F.when(F.col("n") >= wanted, F.col("s")).otherwise(F.lit(-math.inf))
    elsewhere = store.keep(visits(queries.join(bounds, ["q", "d"], "left").withColumn("least", F.coalesce(known, F.lit(-math.inf))), False))
    merged = top(at_home.unionByName(searched(elsewhere)))
    found = store.keep(merged.groupBy("q", "d").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "e", "k"))).alias("found")))
    own = rows.filter(asks).withColumn("v", padded).select("k", "v").distinct()
    each = own.withColumnRenamed("k", "query_id").join(asked, "v").join(found, ["q", "d"])
    others = F.slice(F.filter("found", lambda r: r["e"] | (r["k"] != F.col("query_id"))), 1, nearest)
    flat = each.select("query_id", F.posexplode(others).alias("n", "r"))
    result = flat.select("query_id", (F.col("n") + 1).cast("int").alias("rank"), F.when(~F.col("r.e"), F.col("r.k")).alias("vec_id"), (-F.col("r.s")).alias("score"))
    return result
