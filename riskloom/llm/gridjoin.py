"""Embedding near-duplicates: an epsilon grid order join over leading principal dimensions."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import components
from riskloom.plans.frames import written

LEADING = 8
BLOCK, LEAF = 2048, 256
_SLACK = 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): distinct rows with an id and a finite, non-zero vector without nulls, of any length."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", v.alias("v")).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # the largest component first, so that no square over- or underflows
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame, leading: int = LEADING) -> np.ndarray:
    """The leading eigenvectors of the unit vectors' covariance; only sums of products reach the driver.

    All vectors of `classes` have one length.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                u = _unit(_matrix(batch.column("v")))
                one = np.column_stack([np.ones(len(u)), u])
                total = one.T @ one if total is None else total + one.T @ one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["m"])

    cells = classes.select("v").mapInArrow(add, "m array<double>").select(F.posexplode("m").alias("i", "x"))
    sums = np.array([r.x for r in cells.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()])
    if not len(sums):
        return np.zeros((0, 0))
    d = int(np.sqrt(len(sums)))
    sums = sums.reshape(d, d)
    mean = sums[0, 1:] / sums[0, 0]
    _, vectors = np.linalg.eigh(sums[1:, 1:] / sums[0, 0] - np.outer(mean, mean))
    return np.ascontiguousarray(vectors[:, ::-1][:, :leading])


def axes_by_length(classes: DataFrame, lengths: dict[int, int], leading: int = LEADING, block: int = BLOCK) -> dict[int, np.ndarray]:
    """Orthonormal axes per vector length: principal ones where a length fills more than a block.

    Distances shrink in any projection, so shorter lengths, one block each, take their first coordinates.
    """
    return {d: principal_axes(classes.where(F.size("v") == d), leading) if n > block else np.eye(d)[:, :leading] for d, n in lengths.items()}


def sequence_blocks(classes: DataFrame, axes: dict[int, np.ndarray], rows: int, epsilon: float, block: int = BLOCK) -> DataFrame:
    """Blocks of `block` vectors that follow each other in grid order, with the box of their leading coordinates.

    Grid order compares the length, then the cells of side `epsilon` dimension by dimension. Ties go by the first
    coordinate and the id, so a cell with a third of all vectors is cut like any other stretch. A block
    holds vectors of one length `d`.
    """
    kind = np.float32 if isinstance(classes.schema["v"].dataType.elementType, T.FloatType) else np.float64

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                p = _unit(_matrix(part.column("v"))) @ axes[d]
                cells = np.floor(p / epsilon).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rep"), part.column("n"), part.column("v"), pa.array(np.full(len(part), d, np.int32)),
                        pa.array(list(p), pa.list_(pa.float64())), pa.array(list(cells), pa.list_(pa.int32())),
                    ],
                    ["rep", "n", "v", "d", "p", "cell"],
                )

    schema = f"rep bigint, n bigint, v {classes.schema['v'].dataType.simpleString()}, d int, p array<double>, cell array<int>"
    placed = classes.mapInArrow(place, schema)
    parts = max(1, rows // (4 * block))
    order = ["d", "cell", "first", "rep"]
    ordered = placed.withColumn("first", F.element_at("p", 1)).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        # numbered by partition, whatever rows land in it
        numbers = itertools.count(TaskContext.get().partitionId() << 32)

        def pack(t: pa.Table) -> pa.RecordBatch:
            p, cells = _matrix(t.column("p").combine_chunks()), _matrix(t.column("cell").combine_chunks())
            corner = np.unique(cells[:, :3], axis=0)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([next(numbers)], pa.int64()), pa.array([t.column("d")[0].as_py()], pa.int32()),
                    pa.array([p.min(axis=0)]), pa.array([p.max(axis=0)]),
                    pa.array([[row.tolist() for row in corner]], pa.list_(pa.list_(pa.int32()))),
                    pa.array([t.column("rep").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                    pa.array([t.column("n").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                    pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()),
                    pa.array([_matrix(t.column("v").combine_chunks()).astype(kind).tobytes()], pa.binary()),
                ],
                ["block", "d", "low", "high", "corners", "reps", "counts", "points", "vectors"],
            )

        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(lengths)) + 1):
                if not len(part):
                    continue
                if held and held[0].column("d")[0].as_py() != lengths[part[0]]:
                    yield pack(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(part[0], len(part)))
                while sum(map(len, held)) >= block:
                    t = pa.Table.from_batches(held)
                    yield pack(t.slice(0, block))
                    held = t.slice(block).to_batches()
        if held:
            yield pack(pa.Table.from_batches(held))

    out = "block bigint, d int, low array<double>, high array<double>, corners array<array<int>>, reps binary, counts binary, points binary, vectors binary"
    return ordered.drop("first").mapInArrow(cut, out)


def near_blocks(grid: DataFrame, epsilon: float) -> DataFrame:
    """(i, j), i <= j: blocks of one length that share or neighbour a cell of the first three dimensions and whose boxes are near.

    Blocks meet by equality on the cell, never all with all; boxes further apart than `epsilon` are left out.
    """
    boxes = grid.select("block", "d", "low", "high", F.explode("corners").alias("c"))
    steps = F.array(*[F.array(*map(F.lit, (x, y, z))) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    around = boxes.select(
        F.col("block").alias("i"), "d", F.col("low").alias("a"), F.col("high").alias("b"),
        F.explode(F.transform(steps, lambda s: F.zip_with("c", F.slice(s, 1, F.size("c")), lambda x, y: x + y))).alias("c"),
    )
    met = around.distinct().join(boxes.select(F.col("block").alias("j"), "d", F.col("low"), F.col("high"), "c"), ["d", "c"]).where("i <= j")
    gaps = F.zip_with(
        F.zip_with("a", "high", lambda x, y: x - y), F.zip_with("low", "b", lambda x, y: x - y), lambda x, y: F.pow(F.greatest(x, y, F.lit(0.0)), 2)
    )
    far = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)
    return met.where(far <= epsilon**2 + _SLACK).select("i", "j").distinct()


def _box_gap(p: np.ndarray, q: np.ndarray) -> float:
    gap = np.maximum(np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)), 0)
    return float((gap * gap).sum())


def _join_intervals(a: tuple, b: tuple, same: bool, epsilon: float, least: float, out: list) -> None:
    """Pairs (row of a, row of b) with a cosine of `least` or more; halves intervals and skips distant ones.

    a and b are (offset, leading coordinates, unit vectors in double, the same in single precision).
    """
    if _box_gap(a[1], b[1]) > epsilon**2 + _SLACK:
        return
    if len(a[1]) <= LEAF and len(b[1]) <= LEAF:
        # single precision finds candidates, double precision decides
        x, y = np.nonzero(a[3] @ b[3].T >= least - 1e-4)
        if same:
            x, y = x[x < y], y[x < y]
        sure = np.einsum("ij,ij->i", a[2][x], b[2][y]) >= least
        out.append((x[sure] + a[0], y[sure] + b[0]))
        return

    def halves(s: tuple) -> list[tuple]:
        m = len(s[1]) // 2
        return [(s[0], s[1][:m], s[2][:m], s[3][:m]), (s[0] + m, s[1][m:], s[2][m:], s[3][m:])]

    if same:
        low, high = halves(a)
        for x, y, again in ((low, low, True), (low, high, False), (high, high, True)):
            _join_intervals(x, y, again, epsilon, least, out)
    elif len(a[1]) >= len(b[1]):
        for x in halves(a):
            _join_intervals(x, b, False, epsilon, least, out)
    else:
        for y in halves(b):
            _join_intervals(a, y, False, epsilon, least, out)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges, by union with path halving."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def join_blocks(grid: DataFrame, pairs: DataFrame, epsilon: float, least: float) -> DataFrame:
    """Rows (d, a, b, n): with b, edges of a spanning forest per pair of blocks; without, n links of a among the vectors of length d."""
    left = grid.select(F.col("block").alias("i"), "d", *[F.col(c).alias(f"{c}_i") for c in ("reps", "counts", "points", "vectors")])
    right = grid.select(F.col("block").alias("j"), *[F.col(c).alias(f"{c}_j") for c in ("reps", "counts", "points", "vectors")])
    rows = pairs.join(left, "i").join(right, "j")

    def side(batch: pa.RecordBatch, k: int, s: str) -> tuple:
        reps = np.frombuffer(batch.column(f"reps_{s}")[k].as_py(), np.int64)
        raw, width = batch.column(f"vectors_{s}")[k].as_py(), batch.column("d")[k].as_py()
        dtype = np.float32 if len(raw) == 4 * width * len(reps) else np.float64
        unit = _unit(np.frombuffer(raw, dtype).reshape(len(reps), width))
        points = np.frombuffer(batch.column(f"points_{s}")[k].as_py(), np.float64).reshape(len(reps), -1)
        return reps, np.frombuffer(batch.column(f"counts_{s}")[k].as_py(), np.int64), (0, points, unit, unit.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                same = batch.column("i")[k].as_py() == batch.column("j")[k].as_py()
                reps_a, counts_a, a = side(batch, k, "i")
                reps_b, counts_b, b = (reps_a, counts_a, a) if same else side(batch, k, "j")
                found: list = []
                _join_intervals(a, b, same, epsilon, least, found)
                x = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
                y = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
                sums_a = np.bincount(x, weights=counts_b[y], minlength=len(reps_a))
                sums_b = np.bincount(y, weights=counts_a[x], minlength=len(reps_b))
                edges = _forest(reps_a[x], reps_b[y])
                some_a, some_b = np.flatnonzero(sums_a), np.flatnonzero(sums_b)
                first = [*(e[0] for e in edges), *reps_a[some_a].tolist(), *reps_b[some_b].tolist()]
                second = [*(e[1] for e in edges), *[None] * (len(some_a) + len(some_b))]
                n = [*[None] * len(edges), *sums_a[some_a].astype(int).tolist(), *sums_b[some_b].astype(int).tolist()]
                width = pa.array(np.full(len(n), batch.column("d")[k].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([width, *(pa.array(c, pa.int64()) for c in (first, second, n))], ["d", "a", "b", "n"])

    return rows.mapInArrow(run, "d int, a bigint, b bigint, n bigint")


def near_duplicates(vectors: DataFrame, least: float = 0.9, leading: int = LEADING, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `vectors` (vec_id, embedding).

    Two vectors are linked at a cosine of `least` or more in double precision. Unit vectors at that cosine
    are at most sqrt(2 - 2 least) apart, and not more in any projection, so pruning by leading principal
    coordinates loses nothing. Equal vectors are one class with a count.

    Vectors of each length are joined among themselves. Null, zero and non-finite vectors, vectors with null components
    and rows without vec_id link with nothing. A repeated row counts once and is returned as often as it comes.
    Rows with one vec_id and different vectors are one node of the components; each row counts the links of its own vector.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select("vec_id", "embedding")
    classes = usable(rows).groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    # numbers, not ids, name the classes; the written table fixes them
    classes = written(classes.select(F.monotonically_increasing_id().alias("rep"), "low", "n", "v"))
    lengths = {r.d: r["count"] for r in classes.groupBy(F.size("v").alias("d")).count().collect()}
    epsilon = float(np.sqrt(2 - 2 * least))
    if lengths:
        axes = axes_by_length(classes, lengths, leading, block)
        grid = written(sequence_blocks(classes.drop("low"), axes, sum(lengths.values()), epsilon, block))
        pairs = written(near_blocks(grid, epsilon))
        found = written(join_blocks(grid, pairs, epsilon, least))
    else:
        found = rows.sparkSession.createDataFrame([], "d int, a bigint, b bigint, n bigint")
    known = classes.select("rep", "v")
    members = written(rows.join(known, (rows["embedding"] == known["v"]) & rows["vec_id"].isNotNull(), "left").select("vec_id", "rep"))
    hubs = members.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    shared = members.join(hubs.select("vec_id", "a"), "vec_id").select("a", F.col("rep").alias("b")).where("a < b").distinct()
    roots = components(found.where("b is not null").select("a", "b").unionByName(shared)).distinct()
    degrees = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    named = classes.select("rep", "low", "n").join(degrees, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    lows = named.where("root is not null").groupBy("root").agg(F.min("low").alias("least"))
    named = named.join(lows, "root", "left").select(
        "rep", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("least", "low").alias("low")
    )
    joined = members.join(named, "rep", "left")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("low", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("low", "vec_id"), F.lit(True)).alias("kept"),
    )
