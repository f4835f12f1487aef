"""Exact nearest neighbours without all pairs: cells around pivots, and bounds by the triangle inequality.

Every reference belongs to the cell of its nearest pivot.  A query first meets the nearest cells that hold enough
references, which bounds its k-th distance from above; then only those cells whose nearest possible reference is
within that bound, by the ring that a cell's references lie in and by the plane between two pivots.  Within a cell
references are sorted by their distance to the pivot, so a query looks at a part of its ring.  The result is that of
comparing everything; how much is compared depends on how the data cluster.

Pivots and the counts of cells are of a set size and known to all tasks; cells of many references or visits are
dealt in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.checks import DataError
from tremorlake.sources.shared import cut

#: Pivots at most, and references that one should have: below that there is a single cell.
PIVOTS = 2_048
CELL_ROWS = 16_000
#: Labels that may have neighbours of their own.
SPACES = 256
#: References and visits of a cell that are compared in one task.
BLOCK = 20_000
#: References by which a query's k-th distance is bounded first.
LEAD = 1_024
#: Rounding of bounds, as a share: cells and references this close beyond a bound are looked at.
SLACK = 1e-9


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of every row of x to every one of y, in bounded memory: by a product, and those that it may not tell to
    SLACK by differences."""
    out = np.empty((len(x), len(y)))
    step = max(1, 2_000_000 // max(1, len(y)))
    for at in range(0, len(x), step):
        part = out[at : at + step]
        sizes = _squares(x[at : at + step], y, part)
        i, j = np.nonzero(part < 1e-3 * sizes)
        part[i, j] = _apart(x[at : at + step], y, i, j)
    return np.sqrt(out, out=out)


def _squares(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Squared distances by a product, into out; the size of the numbers that they are differences of."""
    sizes = (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
    np.matmul(x, y.T, out=out)
    out *= -2
    out += sizes
    return sizes


def _apart(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of pairs by differences, in bounded memory."""
    step = max(1, 2_000_000 // max(1, x.shape[1]))
    parts = [((x[i[at : at + step]] - y[j[at : at + step]]) ** 2).sum(1) for at in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.empty(0)


def nearest_of(x: np.ndarray, y: np.ndarray, k: int, bound: np.ndarray, apart: np.ndarray | None) -> list[np.ndarray]:
    """The k smallest distances of each row of x to y within about the bound, rising; apart: pairs that do not count.

    A product gives all squares up to rounding; the k-th of a part of y bounds the k-th of all from above, and what
    may lie within is measured by differences."""
    squares = np.empty((len(x), len(y)))
    sizes = _squares(x, y, squares)
    slack = 16 * (x.shape[1] + 8) * np.finfo("f8").eps * sizes.max(initial=0.0)
    if apart is not None:
        squares[apart] = np.inf
    limit = np.where(np.isfinite(bound), bound**2, np.inf)
    some = squares[:, :: max(1, len(y) // LEAD)]
    if some.shape[1] >= k:
        limit = np.fmin(limit, np.partition(some, k - 1, axis=1)[:, k - 1])
    i, j = np.nonzero((squares <= (limit + 2 * slack)[:, None]) & np.isfinite(squares))
    d = _apart(x, y, i, j)
    by = np.lexsort((d, i))
    d = np.sqrt(d[by])
    ends = np.cumsum(np.bincount(i, minlength=len(x)))
    return [d[a : min(a + k, b)] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]


class Cells:
    """Of each space (a label, or all references) the count and the ring of every pivot's cell."""

    def __init__(self, pivots: np.ndarray, rows: list[tuple[str, int, int, float, float]]):
        self.pivots, m = pivots, len(pivots)
        self.between = distances(pivots, pivots)
        self.count, self.low, self.high = {}, {}, {}
        for space, pivot, n, low, high in rows:
            for told, empty, value in ((self.count, 0, n), (self.low, np.inf, low), (self.high, -np.inf, high)):
                told.setdefault(space, np.full(m, empty, dtype=type(value)))[pivot] = value

    def first(self, d: np.ndarray, space: str, k: int) -> np.ndarray:
        """Which cells each query meets first: the nearest ones that hold more than k references together."""
        order = np.argsort(np.where(self.count[space] > 0, d, np.inf), axis=1, kind="stable")
        held = np.cumsum(self.count[space][order], axis=1)
        wanted = (np.concatenate([np.zeros((len(d), 1)), held[:, :-1]], axis=1) <= k) & (self.count[space][order] > 0)
        out = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(out, order, wanted, axis=1)
        return out

    def further(self, d: np.ndarray, space: str, bound: np.ndarray) -> np.ndarray:
        """Which cells may hold a reference within the bound."""
        own = d.argmin(axis=1)
        apart = self.between[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (d**2 - d.min(axis=1)[:, None] ** 2) / (2 * apart), 0.0)
        nearest = np.maximum(np.maximum(d - self.high[space], self.low[space] - d), plane)
        return (nearest <= bound[:, None] * (1 + SLACK) + SLACK) & (self.count[space] > 0)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("f8")


def assigned(reference: DataFrame, pivots: np.ndarray) -> DataFrame:
    """reference (key, space, vector) with its pivot and the distance to it."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = distances(_vectors(batch["vector"]), pivots)
                own = d.argmin(axis=1)
                yield batch.assign(pivot=own.astype("i4"), dist=d[np.arange(len(d)), own])

    return reference.mapInPandas(nearest, f"key {dict(reference.dtypes)['key']}, space string, vector array<double>, pivot int, dist double")


def visits(queries: DataFrame, cells: Cells, k: int, bounded: bool) -> DataFrame:
    """key, vector, space, pivot, dist, bound: the cells that each query meets; queries: key, vector, and with
    bounds space and bound, of which the first cells are left out."""
    spaces = sorted(cells.count)

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                d = distances(_vectors(part["vector"]), cells.pivots)
                for space in spaces:
                    own = np.flatnonzero(part["space"].to_numpy() == space) if bounded else np.arange(len(part))
                    if not len(own):
                        continue
                    met = cells.first(d[own], space, k)
                    bound = np.full(len(own), np.inf)
                    if bounded:
                        bound = part["bound"].to_numpy()[own]
                        met = cells.further(d[own], space, bound) & ~met
                    i, pivot = np.nonzero(met)
                    yield pd.DataFrame({"key": part["key"].to_numpy()[own[i]], "vector": part["vector"].to_numpy()[own[i]], "space": space, "pivot": pivot.astype("i4"), "dist": d[own[i], pivot], "bound": bound[i]})

    return queries.mapInPandas(plan, f"key {dict(queries.dtypes)['key']}, vector array<double>, space string, pivot int, dist double, bound double")


def compared(met: DataFrame, reference: DataFrame, k: int, apart: frozenset[str] | None) -> DataFrame:
    """key, space, distances: the k smallest of each query in each block of each cell that it meets.  In the spaces
    of apart (None: in all) a query does not meet the reference of its own key."""
    spark = met.sparkSession
    sizes = met.groupBy("space", "pivot").agg(F.count("*").alias("n"), F.lit(0).alias("m")).unionByName(reference.groupBy("space", "pivot").agg(F.lit(0).alias("n"), F.count("*").alias("m")))
    listed = [(s, p, max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))) for s, p, n, m in sizes.groupBy("space", "pivot").agg(F.sum("n"), F.sum("m")).collect()]  # PIVOTS x SPACES at most
    blocks = F.broadcast(spark.createDataFrame(listed, "space string, pivot int, nq long, nr long"))
    number = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    left = met.join(blocks, ["space", "pivot"]).withColumn("bq", number("nq")).withColumn("br", each("nr")).drop("nq", "nr")
    right = reference.join(blocks, ["space", "pivot"]).withColumn("br", number("nr")).withColumn("bq", each("nq")).drop("nq", "nr")

    def search(few: pd.DataFrame, all_of: pd.DataFrame) -> pd.DataFrame:
        if not len(few) or not len(all_of):
            return pd.DataFrame({"key": [], "space": [], "distances": []}).astype(object)
        all_of, few = all_of.sort_values("dist", kind="stable"), few.sort_values("dist", kind="stable")
        points, ring, keys = _vectors(all_of["vector"]), all_of["dist"].to_numpy(), all_of["key"].to_numpy()
        x, own, at_, bound = _vectors(few["vector"]), few["key"].to_numpy(), few["dist"].to_numpy(), few["bound"].to_numpy() * (1 + SLACK) + SLACK
        alone = apart is None or few["space"].iloc[0] in apart
        near: list[np.ndarray] = []
        for at in range(0, len(x), 64):
            part = slice(at, at + 64)
            a = np.searchsorted(ring, (at_[part] - bound[part]).min(), side="left")
            b = np.searchsorted(ring, (at_[part] + bound[part]).max(), side="right")
            same = own[part, None] == keys[None, a:b] if alone else None
            near += nearest_of(x[part], points[a:b], k, bound[part], same)
        return pd.DataFrame({"key": own, "space": few["space"].to_numpy(), "distances": near})

    kind = dict(met.dtypes)["key"]
    by = ["space", "pivot", "bq", "br"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, f"key {kind}, space string, distances array<double>")


def _best(found: DataFrame, k: int) -> DataFrame:
    merged = found.groupBy("key", "space").agg(F.flatten(F.collect_list("distances")).alias("d"))  # k of each block that was met
    return merged.select("key", "space", F.slice(F.sort_array("d"), 1, k).alias("distances"))


class Search:
    """The references in their cells, for any number of queries."""

    def __init__(self, reference: DataFrame, cell_rows: int | None = None):
        """reference: key, vector, space."""
        n = reference.count()
        m = min(PIVOTS, max(1, -(-n // (cell_rows or CELL_ROWS))))
        drawn = reference.orderBy(F.xxhash64("key"), "key").limit(m).select("vector").collect()
        self.n, self.cells = n, None
        if not n:
            return
        pivots = np.unique(np.array([r[0] for r in drawn], dtype="f8"), axis=0)
        self.rows = cut(assigned(reference.select("key", "space", "vector"), pivots))
        told = self.rows.groupBy("space", "pivot").agg(F.count("*"), F.min("dist"), F.max("dist")).limit(SPACES * PIVOTS + 1).collect()
        if len(told) > SPACES * PIVOTS:
            raise DataError(f"over {SPACES} labels")
        self.cells = Cells(pivots, [tuple(r) for r in told])

    def met(self, queries: DataFrame, k: int, apart: frozenset[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """The cells that queries meet in the second round, and what the first one found."""
        first = cut(_best(compared(visits(queries, self.cells, k, False), self.rows, k, apart), k))
        bound = F.when(F.size("distances") >= k, F.element_at("distances", k)).otherwise(F.lit(float("inf")))
        again = queries.join(first.select("key", "space", bound.alias("bound")), "key")
        return visits(again, self.cells, k, True), first

    def nearest(self, queries: DataFrame, k: int, apart: frozenset[str] | None = None) -> DataFrame:
        """key, space, distances.  queries: key (each once), vector."""
        further, first = self.met(queries, k, apart)
        if len(self.cells.pivots) == 1:  # all is met
            return first
        return _best(first.unionByName(compared(cut(further), self.rows, k, apart)), k)

    def pairs(self, queries: DataFrame, k: int) -> int:
        """How many (query, reference) pairs lie in the cells that are met, rings left aside."""
        held = self.rows.groupBy("space", "pivot").agg(F.count("*").alias("n"))
        further, _ = self.met(queries, k)
        both = visits(queries, self.cells, k, False).unionByName(further)
        return both.join(F.broadcast(held), ["space", "pivot"]).agg(F.sum("n")).first()[0] or 0
