"""Nearest neighbours by inner product with a tiny index: stable projections, a kd-tree and a chi-square test.

`PROJECTED` Gaussian (2-stable) projections keep distances in the mean: a projected squared distance divided
by the true one follows a chi-square law. Lengths are not projected but known: a point x with a score of s has
the squared distance |q|^2 + |x|^2 - 2s. So the points of a leaf or cell that can beat the current k-th best
score are within a distance that its own greatest length gives, and it is ruled out if its box is farther than
the chi-square law allows with probability `SURE`. A long vector loosens the bound of its own leaf only. A
search takes leaves in the order of what is left of their bounds and verifies points on the original vectors.

On Spark:
1. Equal vectors become one, with their k + 1 smallest ids (more can't be in any answer): a vector that
   a third of all rows share is one point. A query is a vector too, however many ids ask for it; only an id that has
   several vectors asks for itself, so that it can be left out of its own answer.
2. The upper levels of the kd-tree cut projected space into cells, bounded in rows and bytes. Their planes are fitted
   on at most `SAMPLE` vectors; every vector is then dealt to its cell, and each cell's task grows its own lower levels.
3. Round one searches each query's own cell. Round two sends a query only to those other cells whose box
   the chi-square test does not rule out, with the best distance so far. Tasks know the boxes of the tree's first
   `UPPER` levels only; those of cells further down are met in a join. The queries of a cell are counted: a cell
   gets as many tasks, each with a copy of it, as its own queries fill.

Recall is measured against brute force in the tests; `SURE` is a lower bound of it for each true neighbour.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, as query or candidate; a null vec_id takes no part; rows that share vec_id and vector
count once, rows that share only a vec_id are each a candidate and a query, but none of each other's; ties go to the
smaller vec_id; with fewer candidates than k, all come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.llm.shared import materialize

K = 20
PROJECTED = 10
SURE = 0.9
SEED = 9
SAMPLE = 1 << 14
CELL_ROWS = 1 << 14
CELL_BYTES = 64 << 20
LEAF_ROWS = 64
#: Levels of the tree whose boxes every task of round two knows: at most 2 ** UPPER boxes.
UPPER = 12
#: Queries that meet a cell in one task, about.
QUERY_ROWS = 1 << 14


def chi_square_quantile(p: float, degrees: int) -> float:
    """Of an even number of degrees of freedom, by bisection of the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        below = 1 - math.exp(-mid / 2) * sum((mid / 2) ** k / math.factorial(k) for k in range(degrees // 2))
        low, high = (mid, high) if below < p else (low, mid)
    return high


@lru_cache(maxsize=4)
def projection(size: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, m))


def project(vectors: np.ndarray, m: int, seed: int) -> np.ndarray:
    return vectors @ projection(vectors.shape[1], m, seed)


def reach(length: np.ndarray | float, most: np.ndarray | float, least: np.ndarray | float) -> np.ndarray | float:
    """Squared distance within which points of a squared length up to `most` score `least` or more with a query of squared length `length` (and a little more, for rounding)."""
    return np.maximum(0, length + most - 2 * least) + 1e-12 * (length + most)


def planes(sample: np.ndarray, levels: int) -> list[tuple[int, float]]:
    """Axis and place of the cuts of a kd-tree of so many levels, as a heap (node k has 2k + 1 and 2k + 2)."""
    out: list[tuple[int, float]] = []
    level = [np.arange(len(sample))]
    for _ in range(levels):
        after = []
        for own in level:
            axis = int(np.ptp(sample[own], axis=0).argmax()) if len(own) else 0
            at = float(np.median(sample[own, axis])) if len(own) else 0.0
            out.append((axis, at))
            after += [own[sample[own, axis] <= at], own[sample[own, axis] > at]]
        level = after
    return out


def cell_of(points: np.ndarray, cuts: list[tuple[int, float]], levels: int) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    axes, places = np.array([x[0] for x in cuts], np.int64), np.array([x[1] for x in cuts])
    for _ in range(levels):
        right = points[np.arange(len(points)), axes[node]] > places[node]
        node = 2 * node + 1 + right
    return node - (2**levels - 1)


def leaves(points: np.ndarray, rows: int = LEAF_ROWS) -> list[np.ndarray]:
    """The rows of each leaf of a kd-tree, cut at the median of the widest axis."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= rows:
            out.append(own)
            continue
        values = points[own, int(np.ptp(points[own], axis=0).argmax())]
        order = np.argpartition(values, len(own) // 2)
        todo += [own[order[len(own) // 2 :]], own[order[: len(own) // 2]]]
    return out


class Cell:
    """The points of one cell, ordered by leaf, with their boxes."""

    def __init__(self, vectors: np.ndarray, ids: list, m: int, seed: int) -> None:
        points = project(vectors, m, seed)
        own = leaves(points)
        order = np.concatenate(own)
        self.vectors, self.ids = vectors[order], [ids[k] for k in order]
        self.single = self.vectors.astype(np.float32)
        self.ends = np.cumsum([len(x) for x in own])
        self.low, self.high = (np.array([f(points[x], axis=0) for x in own]) for f in (np.min, np.max))
        lengths = (vectors**2).sum(axis=1)
        self.most = np.array([lengths[x].max() for x in own])  # squared, of each leaf

    def search(self, query: np.ndarray, place: np.ndarray, k: int, least: float, quantile: float, own_id: int | None = None) -> list[tuple[float, int]]:
        """The best (score, id) found, at most k and none of `own_id`, beginning from `least` as the k-th best score elsewhere."""
        gap = np.maximum(0, np.maximum(self.low - place, place - self.high))
        far = (gap**2).sum(axis=1)
        order = np.argsort(far - quantile * self.most, kind="stable")
        length = float((query**2).sum())
        best: list[tuple[float, int]] = []
        single, done, step = query.astype(np.float32), 0, 4
        while done < len(order):
            if least > -math.inf:
                rest = order[done:]
                order, done = rest[far[rest] <= quantile * reach(length, self.most[rest], least)], 0
                if not len(order):
                    break
            own = order[done : done + step]
            rows = np.concatenate([np.arange(self.ends[x - 1] if x else 0, self.ends[x]) for x in own])
            rough = self.single[rows] @ single
            some = rows[rough >= least - 1e-4 * (1 + abs(least))] if least > -math.inf else rows
            if len(some):
                exact = (self.vectors[some] * query).sum(axis=1)
                best += [(s, x) for s, r in zip(exact.tolist(), some.tolist(), strict=True) for x in self.ids[r] if x != own_id]
                best.sort(key=lambda t: (-t[0], t[1]))
                del best[k:]
                if len(best) == k:
                    least = max(least, best[-1][0])
            done, step = done + step, step * 2
        return best


FOUND = "q1 long, q2 long, own long, score double, vec_id long"


def _searched(points: pd.DataFrame, queries: pd.DataFrame, k: int, m: int, seed: int, sure: float) -> pd.DataFrame:
    out: dict[str, list] = {x.split()[0]: [] for x in FOUND.split(", ")}
    if len(points) and len(queries):
        cell = Cell(np.stack(points["vector"].to_numpy()).astype(np.float64), points["ids"].tolist(), m, seed)
        vectors = np.stack(queries["vector"].to_numpy()).astype(np.float64)
        places, quantile = project(vectors, m, seed), chi_square_quantile(sure, m)
        least = queries["least"].fillna(-np.inf).to_numpy() if "least" in queries else np.full(len(queries), -np.inf)
        own = [None if x is None or x != x else int(x) for x in queries["own_text"]]  # as text: a long with nulls would come as double
        for i, (q1, q2) in enumerate(zip(queries["q1"], queries["q2"], strict=True)):
            for score, vec_id in cell.search(vectors[i], places[i], k, least[i], quantile, own[i]):
                for name, value in zip(out, (q1, q2, own[i], score, vec_id), strict=True):
                    out[name].append(value)
    return pd.DataFrame(out).astype({"own": "Int64"})


def nearest(vectors: DataFrame, every: int, k: int = K, m: int = PROJECTED, sure: float = SURE, seed: int = SEED, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the `k` nearest found for each row whose vec_id is divisible by `every`."""
    value = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = vectors.where("vec_id is not null and embedding is not null").where(usable).select("vec_id", value.alias("vector"))
    valid = valid.withColumn("q1", F.xxhash64("vector")).withColumn("q2", F.xxhash64(F.reverse("vector"), F.lit(seed)))
    sizes = valid.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    spark = vectors.sparkSession
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = materialize(valid.where(F.size("vector") == sizes["n"]).dropDuplicates(["q1", "q2", "vec_id"]), "vectors")
    order = W.partitionBy("q1", "q2").orderBy("vec_id")
    few = valid.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)  # each task passes on so many of a vector at most
    points = materialize(few.groupBy("q1", "q2").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "points")
    several = valid.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("vec_id").alias("own"))
    asking = valid.where(F.col("vec_id") % every == 0).join(several, F.col("vec_id") == F.col("own"), "left")
    n = points.count()
    rows = max(LEAF_ROWS, min(cell_rows, CELL_BYTES // (8 * sizes["n"])))
    levels = max(0, math.ceil(math.log2(max(1, n / rows))))
    upper = min(levels, UPPER)
    some = points.orderBy(F.xxhash64("q1", "q2")).limit(sample).select("vector").toPandas()["vector"] if levels else None
    cuts = planes(project(np.stack(some.to_numpy()), m, seed), levels) if levels else []

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at = project(np.stack(batch["vector"].to_numpy()), m, seed)
                yield batch.assign(cell=cell_of(at, cuts, levels))

    held = materialize(points.select("q1", "q2", "vector", "ids").mapInPandas(dealt, "q1 long, q2 long, vector array<double>, ids array<bigint>, cell long"), "cells")
    asked = asking.select("q1", "q2", F.col("own").cast("string").alias("own_text"), "vector").dropDuplicates(["q1", "q2", "own_text"])
    queries = materialize(asked.mapInPandas(dealt, "q1 long, q2 long, own_text string, vector array<double>, cell long"), "queries")

    def search(asked: DataFrame) -> DataFrame:
        """Searches `asked` in the points of its cells."""
        filled = asked.groupBy("cell").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("parts"))
        left = held.join(filled, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        right = asked.join(filled, "cell").withColumn("part", F.pmod("q2", F.col("parts")).cast("int")).drop("parts")
        both = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part"))
        return both.applyInPandas(lambda p, q: _searched(p, q, k + 1, m, seed, sure), FOUND)

    first = materialize(search(queries), "first") if levels else search(queries)
    if levels:

        def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                vectors = np.stack(batch["vector"].to_numpy())
                # the squared length is one more axis
                grouped = pd.DataFrame(np.c_[project(vectors, m, seed), (vectors**2).sum(axis=1)]).groupby(batch["cell"].to_numpy())
                low, high = grouped.min(), grouped.max()
                yield pd.DataFrame({"cell": low.index, "low": low.to_numpy().tolist(), "high": high.to_numpy().tolist()})

        def around(box: DataFrame, by: str) -> DataFrame:
            """One box for all boxes of a `by`."""
            ends = [f(F.get(side, F.lit(a))).alias(f"{side}{a}") for side, f in (("low", F.min), ("high", F.max)) for a in range(m + 1)]
            sides = [F.array(*(F.col(f"{side}{a}") for a in range(m + 1))).alias(side) for side in ("low", "high")]
            return box.groupBy(by).agg(*ends).select(by, *sides)

        box = materialize(around(held.select("cell", "vector").mapInPandas(boxes, "cell long, low array<double>, high array<double>"), "cell").withColumn("above", F.shiftright("cell", levels - upper)), "boxes")
        known = around(box, "above").toPandas()  # 2 ** UPPER rows at most
        low, high = np.stack(known["low"].to_numpy())[:, :-1], np.stack(known["high"].to_numpy())
        high, longest = high[:, :-1], high[:, -1]
        nodes, quantile, step = known["above"].to_numpy(), chi_square_quantile(sure, m), max(1, (1 << 18) // len(known))

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                vectors = np.stack(batch["vector"].to_numpy())
                place, length = project(vectors, m, seed), (vectors**2).sum(axis=1)
                least = batch["least"].fillna(-np.inf).to_numpy()
                batch = batch.assign(place=list(place), length=length)
                for lo in range(0, len(batch), step):
                    own = place[lo : lo + step, None, :]
                    far = (np.maximum(0, np.maximum(low[None] - own, own - high[None])) ** 2).sum(axis=2)
                    row, col = np.nonzero(far <= quantile * reach(length[lo : lo + step, None], longest[None], least[lo : lo + step, None]))
                    yield batch.iloc[lo + row].assign(above=nodes[col])

        best = first.withColumn("own_text", F.col("own").cast("string")).groupBy("q1", "q2", "own_text").agg(F.when(F.count("*") > k, F.min("score")).alias("least"))
        met = queries.withColumnRenamed("cell", "home").join(best.withColumnsRenamed({"q1": "b1", "q2": "b2", "own_text": "b3"}), (F.col("q1") == F.col("b1")) & (F.col("q2") == F.col("b2")) & F.col("own_text").eqNullSafe(F.col("b3")), "left")
        onward = met.select("q1", "q2", "own_text", "vector", "home", "least").mapInPandas(spread, "q1 long, q2 long, own_text string, vector array<double>, home long, least double, place array<double>, length double, above long")
        gap = F.zip_with(F.zip_with(F.col("low"), F.col("place"), lambda a, x: a - x), F.zip_with(F.col("high"), F.col("place"), lambda b, x: x - b), lambda a, b: F.greatest(F.lit(0.0), a, b))  # the length has no place: null
        far = F.aggregate(F.slice(gap, 1, m), F.lit(0.0), lambda acc, x: acc + x * x)
        most = F.element_at("high", -1)
        near = F.greatest(F.lit(0.0), F.col("length") + most - 2 * F.col("least")) + 1e-12 * (F.col("length") + most)
        reached = onward.join(box, "above").where((F.col("cell") != F.col("home")) & (F.col("least").isNull() | (far <= quantile * near)))
        sent = materialize(reached.select("q1", "q2", "own_text", "vector", "cell", "least"), "sent")
        first = first.union(search(sent))
    ranked = first.withColumn("place", F.row_number().over(W.partitionBy("q1", "q2", "own").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    answer = ranked.groupBy("q1", "q2", F.col("own").alias("own_")).agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    met = asking.select(F.col("vec_id").alias("query_id"), "q1", "q2", "own").join(answer.withColumnsRenamed({"q1": "a1", "q2": "a2"}), (F.col("q1") == F.col("a1")) & (F.col("q2") == F.col("a2")) & F.col("own").eqNullSafe(F.col("own_")))
    mine = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return met.select("query_id", F.posexplode(mine).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
