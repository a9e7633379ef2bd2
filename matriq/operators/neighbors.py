"""Exact nearest neighbours by a partition of space: pivots, cells, and distance bounds that rule whole cells out.

Each distinct vector goes to the cell of its nearest pivot. A first round compares a vector with the cells around it, which
bounds how far its neighbours can be; a second visits the cells that the triangle inequality, or the plane between two pivots,
does not put farther away than that. There pairs are told apart by products in single precision, too wide by more than their error;
those left are measured in double. Cosine and Pearson distances are squared chords of unit vectors, so the same bounds hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matriq.lineage import cut

#: Up to so many distinct vectors are one cell; more are cut into about the root of their number, at most MAX_CELLS.
ONE_CELL, MAX_CELLS = 4096, 4096
#: Cells that a first round visits.
HOME = 4
#: Vectors that pivots are fitted on, for each pivot, and rounds of fitting.
SAMPLE, ROUNDS = 8, 4
#: Candidates and visitors that meet in one task, and visitors that are compared at once. Small cells that lie together share a bin.
BLOCK, VISITORS, CHUNK = 16384, 16384, 1024
#: Pairs that a task gathers before it ranks them and narrows its bounds.
PAIRS = 1 << 18
#: Parts that copies of one vector are ranked in before they meet.
SALTS = 32
#: Small tables that are broadcast.
FEW = 20_000
#: Relative slack of bounds, far above rounding errors.
SLACK = 1e-9

VISITS = "uid bigint, v array<double>, within double, bins array<int>, cells array<array<int>>"
PLACED = "uid bigint, v array<double>, ids array<bigint>, cell int, r double"


def points(column: pa.Array) -> np.ndarray:
    """(n, d) of a list column."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def embedded(v: np.ndarray, metric: str, query: bool) -> np.ndarray:
    """Points whose Euclidean distances order as the metric does. Vectors without a direction are at distance 1 of all: one more axis for queries, one for candidates."""
    if metric == "euclidean":
        return v
    if metric == "pearson":
        v = v - v.mean(1, keepdims=True)
    size = np.sqrt((v * v).sum(1, keepdims=True))
    flat = size[:, 0] <= 1e-300
    unit = v / np.where(size > 1e-300, size, 1)
    unit[flat] = 0
    return np.column_stack([unit, flat & query, flat & (not query)])


def exact(p: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of embedded points, without the cancellation of products."""
    return np.sqrt(((p - q) ** 2).sum(1)) if metric == "euclidean" else 1 - (p * q).sum(1)


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * p @ q.T, 0))


def within32(x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Mask (x, y) of all pairs whose squared distance is at most a limit of x, and a few more: one product in single precision, by more than its error too wide."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    size = max(xx.max(initial=0), yy.max(initial=0), 1e-300)
    error = (x.shape[1] + 16) * 2.0**-22  # a sum of as many terms errs by 2 ** -24 of their magnitudes for each
    most = np.minimum(limit / size, 1e30) * (1 + error) + 1e-37
    a = np.column_stack([2 / size**0.5 * x, most - (1 - error) / size * xx, np.ones(len(x))])
    b = np.column_stack([y / size**0.5, np.ones(len(y)), (error - 1) / size * yy])
    return a.astype(np.float32) @ b.astype(np.float32).T >= 0


def distinct_vectors(m: DataFrame, keep: int) -> tuple[DataFrame, DataFrame | None]:
    """((uid, v, ids), (uid, cell_id) of further rows or None): one row a distinct vector, with its `keep` smallest ids.

    Of copies no more can be neighbours of anything. Vectors whose hash no other has pass as they are; only the others are grouped.
    """
    rows = m.where("cell_id IS NOT NULL AND forall(CAST(v AS array<double>), x -> abs(x) < double('Infinity'))").select(F.col("cell_id").cast("long").alias("cell_id"), F.col("v").cast("array<double>").alias("v"), F.xxhash64("v").alias("h"))
    again = cut(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("_h")))
    alone = lambda r: r.select(F.col("cell_id").alias("uid"), "v", F.array("cell_id").alias("ids"))
    if again.isEmpty():
        return cut(alone(rows)), None
    again = F.broadcast(again) if again.limit(FEW + 1).count() <= FEW else again
    copies = rows.join(again, F.col("h") == F.col("_h"), "left_semi")
    salt = Window.partitionBy("h", "v", F.pmod(F.xxhash64("cell_id"), F.lit(SALTS))).orderBy("cell_id")
    few = copies.withColumn("_r", F.row_number().over(salt)).where(F.col("_r") <= keep)
    ids = F.slice(F.array_sort(F.collect_set("cell_id")), 1, keep)  # of SALTS * keep at most
    groups = cut(few.groupBy("h", "v").agg(ids.alias("ids")).select("h", "v", "ids", F.col("ids")[0].alias("uid")))
    others = copies.join(groups.select("h", "v", "uid"), ["h", "v"]).where("cell_id <> uid").select("uid", "cell_id")
    single = alone(rows.join(again, F.col("h") == F.col("_h"), "left_anti"))
    return cut(single.unionByName(groups.select("uid", "v", "ids"))), cut(others)


def pivots(u: DataFrame, n_cells: int, metric: str) -> np.ndarray:
    """Up to n_cells points that part the vectors evenly, fitted on SAMPLE vectors for each: those of smallest hash."""
    got = u.orderBy(F.xxhash64("uid")).limit(SAMPLE * n_cells if n_cells > 1 else 1).select("v").toPandas()["v"]
    p = embedded(np.array(got.tolist(), float), metric, False)
    c = np.unique(p[:n_cells], axis=0)
    for _ in range(ROUNDS if len(c) > 1 else 0):
        of = np.concatenate([distances(p[i : i + 1024], c).argmin(1) for i in range(0, len(p), 1024)])
        sums = np.zeros_like(c)
        np.add.at(sums, of, p)
        n = np.bincount(of, minlength=len(c))
        c = sums[n > 0] / n[n > 0][:, None]
    return c


class Cells:
    """Pivots with the sizes and radii of their cells; says which cells a query has to visit."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        self.n = np.zeros(len(centres), np.int64)
        self.near, self.far = np.zeros(len(centres)), np.zeros(len(centres))
        self.bin = np.zeros(len(centres), np.int32)

    def gather(self, size: int) -> None:
        """Bins of cells that lie together and hold at most `size` vectors, by halving along the widest axis; a larger cell is a bin of its own."""
        todo, number = [np.flatnonzero(self.n > 0)], 0
        while todo:
            c = todo.pop()
            if len(c) > 1 and self.n[c].sum() > size:
                wide = np.ptp(self.centres[c], axis=0).argmax()
                c = c[np.argsort(self.centres[c, wide], kind="stable")]
                half = int(np.clip(np.searchsorted(np.cumsum(self.n[c]), self.n[c].sum() / 2), 1, len(c) - 1))
                todo += [c[:half], c[half:]]
            elif len(c):
                self.bin[c] = number
                number += 1

    def home(self, q: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances to the centres, mask of the HOME nearest cells, or as many as together hold `keep` vectors)."""
        d = distances(q, self.centres)
        mask = np.zeros(d.shape, bool)
        order = np.where(self.n > 0, d, np.inf)
        few = min(HOME, d.shape[1])
        first = np.argpartition(order, few - 1, axis=1)[:, :few]
        np.put_along_axis(mask, first, True, axis=1)
        for i in np.flatnonzero(self.n[first].sum(1) < keep):
            by = np.argsort(order[i], kind="stable")
            upto = int(np.searchsorted(np.cumsum(self.n[by]), keep)) + 1
            mask[i, by[:upto]] = True
        return d, mask & (self.n > 0)[None]

    def further(self, q: np.ndarray, within: np.ndarray, keep: int) -> np.ndarray:
        """Mask of the cells beyond home that may hold a vector within a query's distance."""
        d, home = self.home(q, keep)
        own = d.argmin(1)
        least = np.maximum(d - self.far, self.near - d)
        apart = distances(self.centres, self.centres)[own]
        plane = (d * d - (d[np.arange(len(q)), own] ** 2)[:, None]) / (2 * np.where(apart > 0, apart, np.inf))
        scale = np.abs(q).max(initial=0) + np.abs(self.centres).max(initial=0)
        return (np.maximum(least, plane) <= (within * (1 + SLACK) + SLACK * scale)[:, None]) & ~home & (self.n > 0)[None]


def _placed(u: DataFrame, cells: Cells, metric: str) -> DataFrame:
    """u with the cell of each vector and its distance from the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                d = distances(embedded(points(part.column(1)), metric, False), cells.centres)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell])], names=["uid", "v", "ids", "cell", "r"])

    return u.select("uid", "v", "ids").mapInArrow(run, PLACED)


def _visits(queries: DataFrame, cells: Cells, metric: str, keep: int, first: bool) -> DataFrame:
    """VISITS of queries (uid, v, within): the cells at home, or those beyond that its distance doesn't rule out, by bin. Queries without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                q = embedded(points(part.column(1)), metric, True)
                mask = cells.home(q, keep)[1] if first else cells.further(q, part.column(2).to_numpy(zero_copy_only=False), keep)
                i, cell = np.nonzero(mask)
                order = np.lexsort((cells.bin[cell], i))
                i, cell, of = i[order], cell[order], cells.bin[cell[order]]
                starts = np.flatnonzero((np.diff(i, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
                inner = pa.ListArray.from_arrays(pa.array(np.append(starts, len(i)), pa.int32()), pa.array(cell, pa.int32()))
                outer = pa.array(np.searchsorted(i[starts], np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(outer, pa.array(of[starts], pa.int32())), pa.ListArray.from_arrays(outer, inner)]
                out = pa.RecordBatch.from_arrays([*part.columns, *lists], names=["uid", "v", "within", "bins", "cells"])
                yield out.filter(pa.array(mask.any(1)))

    return queries.select("uid", "v", "within").mapInArrow(run, VISITS)


def _compare(visits: DataFrame, placed: DataFrame, cells: Cells, metric: str, keep: int, calls: dict[int, int] | None = None) -> DataFrame:
    """(src, dst, d): of each visit to a bin's block, the `keep` nearest ids of the cells it is for, within the query's distance. calls: visits of each bin, if known."""
    spark = placed.sparkSession
    size = np.bincount(cells.bin, cells.n)
    calls = calls or {r["bin"]: r["m"] for r in visits.select(F.explode("bins").alias("bin")).groupBy("bin").agg(F.count("*").alias("m")).collect()}  # MAX_CELLS rows at most
    plan = [(b, int(-(-size[b] // BLOCK)), -(-m // VISITORS)) for b, m in calls.items()]
    bins = F.broadcast(spark.createDataFrame(plan, "bin int, _nb int, _nq int"))
    of = F.broadcast(spark.createDataFrame([(int(c), int(cells.bin[c])) for c in np.flatnonzero(cells.n)], "cell int, bin int"))
    part = lambda n, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.select("uid", "v", "within", F.explode(F.arrays_zip("bins", "cells")).alias("e")).select("uid", "v", "within", F.col("e.bins").alias("bin"), "e.cells")
    left = left.join(bins, "bin").withColumn("qb", part("_nq", 1)).withColumn("cb", every("_nb")).select("bin", "qb", "cb", "uid", "v", "within", "cells")
    right = placed.join(of, "cell").join(bins, "bin").withColumn("cb", part("_nb", 2)).withColumn("qb", every("_nq")).select("bin", "qb", "cb", "uid", "v", "ids", "cell")

    pairs = PAIRS

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        a, b = a.combine_chunks(), b.sort_by("cell").combine_chunks()
        q, c = (embedded(points(t["v"].chunk(0)), metric, query) for t, query in ((a, True), (b, False)))
        within = (a["within"].to_numpy() * (1 + SLACK)) ** 2
        lists = a["cells"].chunk(0)
        cell = lists.flatten().to_numpy()
        visitor = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(cell, kind="stable")
        cell, visitor = cell[order], visitor[order]
        known, begin = np.unique(b["cell"].to_numpy(), return_index=True)
        uid = b["uid"].to_numpy()

        def first(i: np.ndarray, j: np.ndarray, d: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.lexsort((tie[j], d, i))
            i, j, d = i[order], j[order], d[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            return i[rank < keep], j[rank < keep], d[rank < keep]

        found: list[tuple[np.ndarray, np.ndarray]] = []
        best = np.zeros(0, int), np.zeros(0, int), np.zeros(0)

        def ranked() -> None:
            """The nearest vectors of all found so far; no visitor looks farther than the last of its own."""
            nonlocal best
            i, j = (np.concatenate([f[s] for f in found]) if found else np.zeros(0, int) for s in (0, 1))
            d = np.concatenate([np.zeros(0), *(exact(q[i[at : at + (1 << 16)]], c[j[at : at + (1 << 16)]], metric) for at in range(0, len(i), 1 << 16))])
            best = first(*(np.concatenate(two) for two in zip(best, (i, j, d), strict=True)), uid)
            found.clear()
            last = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == keep - 1)
            d = best[2][last] * (1 + SLACK)
            within[best[0][last]] = np.minimum(within[best[0][last]], d * d if metric == "euclidean" else 2 * np.maximum(d, 0) + 1e-14)

        for name, lo, hi in zip(known, begin, [*begin[1:], len(c)], strict=True):
            mid = c[lo:hi].mean(0)
            y = c[lo:hi] - mid
            yy, k = (y * y).sum(1)[None], min(keep, hi - lo)
            who = visitor[slice(*np.searchsorted(cell, [name, name + 1]))]
            for at in range(0, len(who), CHUNK):
                mine = who[at : at + CHUNK]
                x = q[mine] - mid
                if np.isfinite(within[mine]).all():
                    u, v = np.nonzero(within32(x, y, within[mine]))
                else:
                    square = (x * x).sum(1)[:, None] + yy
                    d2 = square - 2 * x @ y.T
                    worst = np.minimum(np.partition(d2, k - 1, axis=1)[:, k - 1], within[mine])
                    u, v = np.nonzero(d2 <= worst[:, None] + 1e-12 * square)
                found.append((mine[u], v + lo))
            if sum(len(f[0]) for f in found) > pairs:
                ranked()
        ranked()
        i, j, d = best  # of the nearest vectors' ids the first
        ids = b["ids"].chunk(0)
        many = np.diff(ids.offsets.to_numpy())
        ids, start = ids.flatten().to_numpy(), np.cumsum(many) - many
        times = many[j]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        i, j, d = first(np.repeat(i, times), np.repeat(start[j], times) + at, np.repeat(d, times), ids)
        return pa.table({"src": a["uid"].to_numpy()[i], "dst": ids[j], "d": d})

    key = ["bin", "qb", "cb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "src long, dst long, d double")


def _best(found: DataFrame, keep: int) -> DataFrame:
    """(src, best): the `keep` nearest of what was found, by distance and id."""
    w = Window.partitionBy("src").orderBy("d", "dst")
    few = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep)
    return few.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("d", "dst"))).alias("best"))


def nearest(m: DataFrame, k: int, metric: str = "euclidean", cells: int | None = None) -> DataFrame:
    """(src, dst, d, rank): the k nearest others of each vector of m (cell_id, v), exactly; ties by dst.

    metric: euclidean, cosine or pearson (distances of 1 - r). cells: number of cells, if not the root of the number of vectors.
    The driver holds pivots and one row a cell. Cells that are large, or visited by many, are cut into blocks, and small
    ones that lie together meet their visitors in one task, which holds about BLOCK candidates and VISITORS queries. Copies
    of a vector are compared once. Vectors that are null, or have an element that is null or no finite number, are left out.
    """
    keep = k + 1
    u, others = distinct_vectors(m, keep)
    n = u.count()
    if not n:
        return m.sparkSession.createDataFrame([], "src long, dst long, d double, rank int")
    cells = cells or (1 if n <= ONE_CELL else min(MAX_CELLS, round(n**0.5)))
    if cells == 1:  # all in one cell, which has no need of a pivot
        book = Cells(np.zeros((1, 1)))
        book.n[0] = n
        placed = u.withColumn("cell", F.lit(0))
        visits = placed.select(F.col("uid").alias("uid"), F.col("v").alias("v"), F.lit(float("inf")).alias("within"), F.array(F.lit(0)).alias("bins"), F.array(F.array(F.lit(0))).alias("cells"))
        return _expanded(_best(_compare(visits, placed, book, metric, keep, {0: n}), keep), others, k)
    book = Cells(pivots(u, cells, metric))
    placed = cut(_placed(u, book, metric))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("near"), F.max("r").alias("far")).collect():  # MAX_CELLS rows at most
        book.n[r["cell"]], book.near[r["cell"]], book.far[r["cell"]] = r["n"], r["near"], r["far"]
    book.gather(BLOCK)
    asked = placed.select("uid", "v", F.lit(float("inf")).alias("within"))
    best = _best(_compare(_visits(asked, book, metric, keep, True), placed, book, metric, keep), keep)
    best = cut(best)
    worst = F.when(F.size("best") >= keep, F.element_at("best", -1)["d"]).otherwise(float("inf"))
    worst = worst if metric == "euclidean" else F.sqrt(2 * F.greatest(worst, F.lit(0.0)))
    bound = best.select(F.col("src").alias("uid"), worst.alias("within"))
    visits = cut(_visits(placed.select("uid", "v").join(bound, "uid"), book, metric, keep, False))
    more = _compare(visits, placed, book, metric, keep)
    best = _best(best.select("src", F.explode("best").alias("b")).select("src", "b.dst", "b.d").unionByName(more), keep)
    return _expanded(best, others, k)


def _expanded(best: DataFrame, others: DataFrame | None, k: int) -> DataFrame:
    """(src, dst, d, rank) of every row: copies of a vector share what was found for it, but for themselves."""
    best = best.withColumn("cell_id", F.col("src"))
    if others is not None:
        best = cut(best)
        best = best.unionByName(best.drop("cell_id").join(others.withColumnRenamed("uid", "src"), "src"))
    mine = F.expr(f"slice(filter(best, b -> b.dst <> cell_id), 1, {int(k)})")
    out = best.select("cell_id", F.posexplode(mine).alias("rank", "b"))
    return out.select(F.col("cell_id").alias("src"), "b.dst", "b.d", (F.col("rank") + 1).alias("rank"))
