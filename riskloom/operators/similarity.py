"""Cosine top-k: exact in blocks, or approximate in the nearest cells of a k-means partition."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.clusters import as_vectors
from riskloom.plans.frames import attach, settle, written
from riskloom.plans.ranking import dense_numbers
from riskloom.session import shared_folder
from riskloom.sources.versions import VersionedTable

BROADCAST_NUMBERS = 4_000_000
#: Candidates that one task of a broadcast search may hold and give.
BROADCAST_HITS = 500_000
#: Most rows of a block, and most numbers in its vectors; blocks of queries are made smaller for more tasks, not below LEAST_QUERIES.
QUERY_BLOCK, BASE_BLOCK, BLOCK_NUMBERS, LEAST_QUERIES = 131_072, 524_288, 4_194_304, 2_048
STEP = 512
#: Numbers of a block's base vectors that are turned to doubles at once.
PART_NUMBERS = 524_288
#: Rows of a leaf and of a tile of queries, and most leaves compared at once.
LEAF, TILE, MOST_LEAVES = 256, 256, 4
#: Distances are rounded to nine digits: bounds keep what could round to the same.
SLACK = 2e-9


def _unit(vectors: pd.Series) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 0))
    return _turned_to_one(np.vstack(vectors.to_numpy()).astype(np.float64))


def _turned_to_one(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a list column; rows of zeros or missing numbers are NaN."""
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError("vectors of different lengths")
    out = np.empty((n, lengths["min"]))
    step, start = max(LEAF, PART_NUMBERS // max(1, lengths["min"])), 0
    for chunk in column.chunks:
        for at in range(0, len(chunk), step):
            part = chunk.slice(at, step)
            flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            out[start : start + len(part)] = _turned_to_one(flat.reshape(len(part), -1))
            start += len(part)
    return out


def _parts(table: pa.Table) -> Iterator[pa.Table]:
    """A block in slices of whole rows, so that only the doubles of one are held."""
    longest = pc.max(pc.list_value_length(table["vector"])).as_py() or 1
    step = max(LEAF, PART_NUMBERS // longest)
    return (table.slice(at, step) for at in range(0, len(table), step))


def _leaves(m: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in parts of at most `size` rows, halved along the widest column each time."""
    out, todo = [], [np.arange(len(m))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = m[rows]
        half = len(rows) // 2
        order = np.argpartition(part[:, np.argmax(part.max(axis=0) - part.min(axis=0))], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


def _few_copies(ids: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Row numbers without those copies of a vector that k others of smaller ids keep out of every answer."""
    _, group = np.unique(m, axis=0, return_inverse=True)
    group = group.ravel()
    if not len(ids) or np.bincount(group).max() <= k:
        return np.arange(len(ids))
    own = np.unique(ids, return_counts=True)[1].max()  # a query may skip all rows of its own id
    order = np.lexsort((ids, group))
    first = np.r_[True, group[order][1:] != group[order][:-1]]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return np.sort(order[place < k + own])


class _Base:
    """Rows in leaves with centres and radii; leaves that cannot hold one of the k nearest rows of a query are passed over."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, k: int):
        fine = np.flatnonzero(np.isfinite(m).all(axis=1))
        ids, m = ids[fine], m[fine]
        rows = _few_copies(ids, m, k)
        ids, m = ids[rows], m[rows]
        parts = _leaves(m, LEAF)
        order = np.concatenate(parts)
        self.ids, self.m, self.k = ids[order], m[order], k
        self.ends = np.cumsum([len(p) for p in parts])
        self.starts = self.ends - np.array([len(p) for p in parts])
        if len(ids):
            self.centres = np.array([self.m[a:b].mean(axis=0) for a, b in zip(self.starts, self.ends)])
            self.radii = np.array([np.sqrt(((self.m[a:b] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(self.starts, self.ends, self.centres)])

    def search(self, names: np.ndarray, q: np.ndarray, best: np.ndarray, found: np.ndarray, skip_same: bool) -> None:
        """Put the nearest rows of a tile of queries into `best` (distances, ascending) and `found` (ids), both with k columns."""
        if not len(self.ids):
            return
        square = (q * q).sum(axis=1)[:, None] - 2.0 * (q @ self.centres.T) + (self.centres * self.centres).sum(axis=1)
        reach = np.maximum(np.sqrt(np.maximum(square, 0.0)) - self.radii, 0.0)
        least = reach * reach / 2.0  # of unit rows, half the squared gap is 1 - cosine
        order = np.argsort(least.min(axis=0), kind="stable")
        take = 1
        while len(order):
            order = order[(least[:, order] <= best[:, -1:] + SLACK).any(axis=0)]
            now, order = order[:take], order[take:]
            take = min(2 * take, MOST_LEAVES)
            if len(now):
                self._compare(np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in now]), names, q, best, found, skip_same)

    def _compare(self, rows: np.ndarray, names: np.ndarray, q: np.ndarray, best: np.ndarray, found: np.ndarray, skip_same: bool) -> None:
        ids, k = self.ids[rows], self.k
        distance = 1.0 - q @ self.m[rows].T
        worst = best[:, -1]
        if len(rows) > k and np.isinf(worst).any():
            if skip_same:
                distance[names[:, None] == ids[None, :]] = np.inf
            worst = np.minimum(worst, np.partition(distance, k - 1, axis=1)[:, k - 1])
        at, column = np.nonzero(distance <= (worst + SLACK)[:, None])
        near, other = np.round(distance[at, column], 9), ids[column]
        better = np.isfinite(near) & ((near < best[at, -1]) | ((near == best[at, -1]) & (other < found[at, -1])))
        if skip_same:
            better &= names[at] != other
        if not better.any():
            return
        at, near, other = at[better], near[better], other[better]
        hit = np.unique(at)
        at = np.concatenate([at, np.repeat(hit, k)])
        near, other = np.concatenate([near, best[hit].ravel()]), np.concatenate([other, found[hit].ravel()])
        by = np.lexsort((other, near, at))
        at, near, other = at[by], near[by], other[by]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < k
        best[at[kept], place[kept]], found[at[kept], place[kept]] = near[kept], other[kept]


class _Asked:
    """Queries in tiles of near rows, with their best k so far."""

    def __init__(self, names: np.ndarray, m: np.ndarray, k: int, skip_same: bool):
        fine = np.isfinite(m).all(axis=1)
        if not fine.all():
            names, m = names[fine], m[fine]
        parts = _leaves(m, TILE)
        order = np.concatenate(parts)
        self.names, self.m, self.k, self.skip_same = names[order], m[order], k, skip_same
        self.ends = np.cumsum([len(p) for p in parts])

    def start(self) -> None:
        self.best = np.full((len(self.names), self.k), np.inf)
        self.found = np.full((len(self.names), self.k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, m: np.ndarray) -> None:
        if not len(ids) or not len(self.names):
            return
        base = _Base(ids, m, self.k)
        for a, b in zip(np.r_[0, self.ends[:-1]], self.ends):
            base.search(self.names[a:b], self.m[a:b], self.best[a:b], self.found[a:b], self.skip_same)

    def hits(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.names), max(1, 65_536 // self.k)):
            b = a + max(1, 65_536 // self.k)
            rows, places = np.nonzero(np.isfinite(self.best[a:b]))
            columns = [self.names[a:b][rows], self.found[a:b][rows, places], self.best[a:b][rows, places]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "id", "distance"])


_HITS = "query_id long, id long, distance double"


def _merge(candidates: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= k)


def _by_broadcast(queries: DataFrame, base: DataFrame, k: int, skip_same: bool) -> DataFrame:
    """Few queries: every task compares its part of the base with all of them and gives k rows a query."""
    local = queries.select("query_id", "vector").toPandas()
    asked = _Asked(local["query_id"].to_numpy().astype(np.int64), _unit(local["vector"]), k, skip_same)
    shared = queries.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        mine.start()
        for batch in batches:
            part = pa.Table.from_batches([batch])
            mine.meet(_longs(part["id"]), _matrix(part["vector"]))
        yield from mine.hits()

    # a table in few files would be searched by few tasks
    parts = queries.sparkSession.sparkContext.defaultParallelism
    return base.select("id", "vector").repartition(parts, "id").mapInArrow(run, _HITS)


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def _by_blocks(queries: DataFrame, base: DataFrame, k: int, skip_same: bool) -> DataFrame:
    """Blocks of queries meet blocks of the base inside their cell; each pair of blocks is one group
    of bounded size and gives k rows per query. A big cell is cut into more blocks."""
    parallel = queries.sparkSession.sparkContext.defaultParallelism
    rows = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_NUMBERS) / F.col("d")))
    sizes = (
        queries.groupBy("cell").agg(F.count(F.lit(1)).alias("q"))
        .join(base.groupBy("cell").agg(F.count(F.lit(1)).alias("b"), F.max(F.size("vector")).alias("d")), "cell")
        .select("cell", "q", F.ceil(F.col("q") / F.least(F.lit(QUERY_BLOCK), rows)).cast("int").alias("nq"), F.ceil(F.col("b") / F.least(F.lit(BASE_BLOCK), rows)).cast("int").alias("nb"))
    )
    sizes = settle(sizes)
    least = sizes.agg(F.sum(F.col("nq") * F.col("nb"))).first()[0] or 0
    if least < 4 * parallel:  # few pairs of blocks: more of smaller blocks of queries, so that all cores have work
        times = math.ceil(4 * parallel / max(1, least))
        sizes = sizes.withColumn("nq", F.greatest("nq", F.least(F.col("nq") * times, F.ceil(F.col("q") / min(LEAST_QUERIES, QUERY_BLOCK)).cast("int"))))
    groups = sizes.agg(F.sum(F.col("nq") * F.col("nb"))).first()[0] or 1
    tasks = int(min(4_096, max(2 * groups, parallel)))  # numbered partitions stay apart however few bytes they hold

    def place(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        mine, theirs = ("qb", "bb") if own == "nq" else ("bb", "qb")
        spread = df.join(F.broadcast(sizes), "cell").select(  # a row per cell, at most 4,096
            "cell", key, "vector",
            F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs),
        )
        return spread.repartition(tasks, *keys)

    keys = ["cell", "qb", "bb"]
    left = place(queries, "query_id", "nq", "nb").groupBy(*keys)
    right = place(base, "id", "nb", "nq").groupBy(*keys)

    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        asked = _Asked(_longs(q["query_id"]), _matrix(q["vector"]), k, skip_same)
        asked.start()
        for part in _parts(b):
            asked.meet(_longs(part["id"]), _matrix(part["vector"]))
        return pa.Table.from_batches(asked.hits(), _ARROW_HITS)

    return left.cogroup(right).applyInArrow(run, _HITS)


_ARROW_HITS = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])
#: Stands for an id of null, which is no query and as a base row comes before all others.
_NO_ID = -(2**63)


class _Keys:
    """Ids as long numbers of the same order while rows are compared: whole numbers as they are, others numbered in their order."""

    def __init__(self, df: DataFrame, name: str, names: DataFrame | None = None):
        self.name, self.kind = name, df.schema[name].dataType
        self.names = names
        if names is None and not isinstance(self.kind, T.IntegralType):
            self.names = written(dense_numbers(df.select(F.col(name).alias("__id")).distinct(), "__id", "__number"))

    def numbers(self, df: DataFrame) -> DataFrame:
        if self.names is None:
            return df.withColumn(self.name, F.coalesce(F.col(self.name).cast("long"), F.lit(_NO_ID)))
        table = self.names.withColumnsRenamed({"__id": self.name})
        return attach(df, table, [self.name], "inner").drop(self.name).withColumnRenamed("__number", self.name)

    def ids(self, df: DataFrame) -> DataFrame:
        if self.names is None:
            return df.withColumn(self.name, F.when(F.col(self.name) != _NO_ID, F.col(self.name)).cast(self.kind))
        table = self.names.withColumnRenamed("__number", self.name)
        return df.join(table, self.name).drop(self.name).withColumnRenamed("__id", self.name)


def _keyed(queries: DataFrame, base: DataFrame, skip_same: bool) -> tuple[_Keys, _Keys]:
    """Both sides' keys; where equal ids must be told, both have the same numbers."""
    kinds = queries.schema["query_id"].dataType, base.schema["id"].dataType
    if not skip_same or all(isinstance(x, T.IntegralType) for x in kinds):
        return _Keys(queries, "query_id"), _Keys(base, "id")
    both = queries.select(F.col("query_id").alias("__id")).union(base.select(F.col("id").alias("__id"))).distinct()
    names = written(dense_numbers(both, "__id", "__number"))
    return _Keys(queries, "query_id", names=names), _Keys(base, "id", names=names)


def _named(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    rows = df.select(F.col(key).alias(name), F.col(vector).alias("vector"))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0))


def cosine_top_k(
    queries: DataFrame,
    base: DataFrame,
    k: int = 3,
    key: str = "id",
    vector: str = "embedding",
    skip_same: bool = False,
    digits: int = 4,
    broadcast_numbers: int = BROADCAST_NUMBERS,
) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest base rows by `1 - cosine`, exact.

    Zero vectors have no distance and never match. Whatever the sizes, no task holds more than one
    block of each side and no pair but the k best of a block is ever written; ids travel as numbers.
    """
    q, b = _named(queries, key, vector, "query_id").where("query_id IS NOT NULL"), _named(base, key, vector, "id")
    asked, known = _keyed(q, b, skip_same)
    q, b = written(asked.numbers(q)), known.numbers(b)
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    if (size["n"] or 0) * (size["d"] or 0) <= broadcast_numbers and (size["n"] or 0) * k <= BROADCAST_HITS:
        found = _by_broadcast(q, b, k, skip_same)
    else:
        b = b if known.names is None else written(b)
        found = _by_blocks(q.withColumn("cell", F.lit(0)), b.withColumn("cell", F.lit(0)), k, skip_same)
    return _ranked(_merge(found, k), asked, known, digits)


def _ranked(best: DataFrame, asked: _Keys, known: _Keys, digits: int) -> DataFrame:
    return asked.ids(known.ids(best)).select("query_id", "id", F.round("distance", digits).alias("distance"), "rank")


@dataclass
class SharedHits:
    """Hits of queries that share them: `members` (query_id, group), `hits` (group, id, distance, rank and, if wanted, document)."""

    members: DataFrame
    hits: DataFrame

    def rows(self) -> DataFrame:
        """(query_id, id, distance, rank, ...): the hits of every query."""
        found = [c for c in self.hits.columns if c != "group"]
        return self.members.join(self.hits, "group").select("query_id", *found)


#: Bounds of what an index is fitted on: rows for the centres, most cells, queries for the probes.
FIT_ROWS, MOST_CELLS, FIT_QUERIES = 200_000, 4_096, 2_000
#: The recall that probes are chosen for; a little above the 0.9 that a search has to reach on other queries.
TARGET_RECALL = 0.95


class CosineIndex:
    """A kept approximate index: k-means centres, rows in folders by cell, and probes chosen by measured recall.

    `<path>/rows` is a versioned table of (id, vector, cell) partitioned by cell, `<path>/about` holds the centres and the
    calibration. Centres are fitted on about `fit_rows` rows chosen by a hash of the key (all rows when fewer), probes on
    rows that serve as queries; every row is indexed. `add` places new rows in the cells there are; `calibrate`
    measures again. A search reads the folders of the probed cells only. Zero vectors have no direction: they are
    left out and never match.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.rows = VersionedTable(spark, f"{self.path}/rows")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.cells, self.probes = about["cells"], about["probes"]
        self.recall, self.k = about["recall"], about["k"]
        self._centres = np.array(about["centres"], dtype=np.float64).reshape(self.cells, -1)  # at most 4,096 rows

    @classmethod
    def build(
        cls, base: DataFrame, path: str, key: str = "id", vector: str = "embedding", cells: int | None = None, k: int = 10,
        target: float | None = TARGET_RECALL, seed: int = 42, fit_rows: int = FIT_ROWS, rounds: int = 20,
    ) -> CosineIndex:
        """Fit, place and calibrate; `cells` is the square root of the rows up to 4,096 unless given.

        Without a `target` nothing is measured and all cells are probed.
        """
        spark = base.sparkSession
        b = _named(base, key, vector, "id").where(_turned())
        units = written(as_vectors(b.withColumn("unit", _unit_column("vector")), "unit", "features"))
        n = units.count()
        if not n:
            raise ValueError("no rows with a direction to index")
        cells = min(cells, n) if cells else min(MOST_CELLS, math.isqrt(n))
        share = max(1, n // max(fit_rows, cells))
        sample = units.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(share)) == 0) if share > 1 else units
        model = KMeans(featuresCol="features", predictionCol="cell", k=cells, seed=seed, maxIter=rounds).fit(sample)
        centres = np.array(model.clusterCenters())
        placed = model.transform(units).select("id", "vector", "cell").repartition("cell")
        VersionedTable(spark, f"{path.rstrip('/')}/rows").write(placed, ["cell"])
        _about(spark, path, centres, len(centres), 1.0, k)
        index = cls(spark, path)
        if target is not None:
            index.calibrate(k, target)
        return index

    def nearest_cells(self, queries: DataFrame, probes: int, rank: bool = False) -> DataFrame:
        """(query_id, vector, cell) for the cells nearest to each query; if `rank`, `place` from 0 instead of the vector."""
        centres = self.spark.sparkContext.broadcast(self._centres)
        kept = ["query_id"] if rank else ["query_id", "vector"]
        fields = [*(queries.schema[c] for c in kept), T.StructField("cell", T.IntegerType())]
        fields += [T.StructField("place", T.IntegerType())] if rank else []
        step = max(1, min(STEP, 16_384 // max(1, probes)))  # rows given at once

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = centres.value
            for pdf in batches:
                for start in range(0, len(pdf), step):
                    rows = pdf.iloc[start : start + step]
                    gap = (c * c).sum(axis=1) - 2.0 * (_unit(rows["vector"]) @ c.T)  # |x| is the same for all cells
                    nearest = np.argsort(gap, axis=1, kind="stable")[:, :probes]
                    wide = rows[kept].loc[rows.index.repeat(nearest.shape[1])].assign(cell=nearest.ravel().astype(np.int32))
                    yield wide.assign(place=np.tile(np.arange(nearest.shape[1], dtype=np.int32), len(rows))) if rank else wide

        return queries.select("query_id", "vector").mapInPandas(run, T.StructType(fields))

    def calibrate(self, k: int | None = None, target: float = TARGET_RECALL) -> int:
        """Choose the probes: the fewest nearest cells that hold `target` of the exact `k` nearest rows of the queries.

        Queries are the rows whose id (or, for other keys, its hash) is divisible by 50, at most about 2,000 of them by
        hash; each is compared with all rows, itself left out. One pass tells for every neighbour how many cells a
        search has to look into, so all settings are measured at once.
        """
        k = k or self.k
        rows = self.rows.read()
        number = F.col("id") if isinstance(rows.schema["id"].dataType, T.IntegralType) else F.xxhash64("id")
        asked = rows.where(F.pmod(number, F.lit(50)) == 0)
        n = asked.count()
        if not n:
            asked, n = rows, rows.count()
        share = max(1, n // FIT_QUERIES)
        asked = asked.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(share)) == 0) if share > 1 else asked
        queries = written(asked.select(F.col("id").alias("query_id"), "vector"))
        exact = cosine_top_k(queries.withColumnRenamed("query_id", "id"), rows, k, "id", "vector", True).select("query_id", "id")
        ranked = self.nearest_cells(queries, self.cells, rank=True).select("query_id", "cell", "place")
        needed = exact.join(rows.select("id", "cell"), "id").join(ranked, ["query_id", "cell"])
        counts = sorted((r["place"], r["n"]) for r in needed.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per cell
        total, found, probes = sum(c for _, c in counts), 0, self.cells
        for place, c in counts:
            found += c
            if found >= target * total:
                probes = place + 1
                break
        self.probes, self.k, self.recall = probes, k, found / total if total else 1.0
        _about(self.spark, self.path, self._centres, probes, self.recall, k)
        return probes

    def add(self, rows: DataFrame, key: str = "id", vector: str = "embedding") -> int:
        """Publish the index with more rows, each in its nearest cell."""
        new = _named(rows, key, vector, "query_id").where(_turned())
        placed = self.nearest_cells(new, 1).withColumnRenamed("query_id", "id")
        return self.rows.append(placed.repartition("cell"), ["cell"])

    def search(
        self, queries: DataFrame, k: int = 3, key: str = "id", vector: str = "embedding", probes: int | None = None, skip_same: bool = False, digits: int = 4
    ) -> DataFrame:
        """(query_id, id, distance, rank) among the rows of the probed cells; with `probes` of all cells it is exact."""
        q = _named(queries, key, vector, "query_id").where(_turned()).where("query_id IS NOT NULL")
        asked, known = _keyed(q, self.rows.read(), skip_same)
        near = written(self.nearest_cells(asked.numbers(q), min(probes or self.probes, self.cells)))
        cells = [r["cell"] for r in near.select("cell").distinct().collect()]  # at most 4,096
        rows = known.numbers(self.rows.read().where(F.col("cell").isin(cells) if cells else F.lit(False)))
        found = _by_blocks(near, rows, k, skip_same)
        return _ranked(_merge(found, k), asked, known, digits)


def _turned() -> Column:
    return F.exists("vector", lambda x: x != 0)


def _about(spark: SparkSession, path: str, centres: np.ndarray, probes: int, measured: float, k: int) -> None:
    row = [(len(centres), int(probes), float(measured), int(k), centres.ravel().tolist())]
    about = spark.createDataFrame(row, "cells int, probes int, recall double, k int, centres array<double>")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/about")


def cosine_top_k_approximate(
    queries: DataFrame,
    base: DataFrame,
    k: int = 3,
    key: str = "id",
    vector: str = "embedding",
    cells: int | None = None,
    probes: int | None = None,
    seed: int = 42,
    skip_same: bool = False,
    digits: int = 4,
    fit_rows: int = FIT_ROWS,
    rounds: int = 20,
) -> DataFrame:
    """Top-k among the k-means cells nearest to the query; exact when probes >= cells.

    Builds a `CosineIndex` in the shared folder and searches it once. Unless given, `cells` is the square root of the
    base rows up to 4,096, and `probes` is chosen by recall measured on rows of the base, so it grows with the cells.
    """
    turned = _named(base, key, vector, "id").where(_turned())
    if not turned.limit(1).collect():
        return cosine_top_k(queries.limit(0), turned.withColumnsRenamed({"id": key, "vector": vector}), k, key, vector, skip_same, digits)
    path = shared_folder(base.sparkSession, "indexes", uuid.uuid4().hex)
    index = CosineIndex.build(base, path, key, vector, cells, max(k, 10), None if probes else TARGET_RECALL, seed, fit_rows, rounds)
    return index.search(queries, k, key, vector, probes, skip_same, digits)


def _unit_column(name: str):
    doubles = F.col(name).cast("array<double>")
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(doubles, lambda x: x / F.nullif(norm, F.lit(0.0)))


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact results that the approximate search found."""
    hit = exact.join(approximate.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
