"""Hard negatives by branch and bound on decomposed vectors (BOND): whole numbers, exact windows.

Vectors are stored in blocks, a column of numbers per dimension. An anchor reads the columns in descending order of
its own magnitudes; after each few columns the smallest and largest product that the unread ones can still add bound
every row's score, and rows that can no longer matter leave the candidate bitmap.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.plans.frames import written

#: Rows of a block of the base, and anchors of a block of anchors.
BASE_ROWS, ANCHOR_ROWS = 4096, 512
#: Blocks of anchors that travel together: what a task holds of them is bounded.
LANE_BLOCKS = 64
#: Columns read between two looks at the bounds.
STRIDE = 8
#: Sums below this are exact in double precision; larger ones are computed with whole numbers of any size.
EXACT = float(1 << 52)
_LONG = (1 << 63) - 1


def usable(rows: DataFrame, key: str, label: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, label, v): rows with key, label and vector whose components, times `scale`, are finite; v is floor(scale * x)."""
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: F.when(F.abs(x * scale) < float("inf"), x * scale))
    told = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("x"))
    told = told.where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(~F.exists("x", lambda x: x.isNull() | F.isnan(x)))
    return told.select("id", "label", F.col("x").alias("v"))


def _packed(extra: tuple[str, ...] = ()):
    """A function that packs rows (id, label, v, extra...) of its partition into blocks of one vector length each."""

    def pack(size: int):
        names = ["id", "label", *extra]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple]] = {}
            part, made = TaskContext.get().partitionId(), 0

            def block(d: int) -> pa.RecordBatch:
                nonlocal made
                parts = held.pop(d)
                matrix = np.floor(np.concatenate([p[0] for p in parts])).T  # a row per dimension
                largest = np.abs(matrix).max(initial=0.0)
                kind = next((k for k, top in (("<i2", 2**15), ("<i4", 2**31)) if largest < top), "<f8")
                row = {"block": [part * (1 << 32) + made], "d": [d], "rows": [matrix.shape[1]], "kind": [kind], "columns": [np.ascontiguousarray(matrix, dtype=kind).tobytes()]}
                for i, name in enumerate(names):
                    row[name] = [np.concatenate([p[1][i] for p in parts]).astype("<i8").tobytes()]
                made += 1
                return pa.RecordBatch.from_pydict(row)

            for batch in batches:
                sizes = np.diff(batch.column("v").offsets.to_numpy())
                flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
                for d in np.unique(sizes):
                    at = np.flatnonzero(sizes == d)
                    matrix = flat[(ends[at] - d)[:, None] + np.arange(d)]
                    for i in range(0, len(at), size):
                        piece = at[i : i + size]
                        held.setdefault(int(d), []).append((matrix[i : i + size], [c[piece] for c in columns]))
                        if sum(len(p[0]) for p in held[int(d)]) >= size:
                            yield block(int(d))
            for d in list(held):
                yield block(d)

        return run

    schema = "block long, d long, rows long, kind string, columns binary, " + ", ".join(f"{n} binary" for n in ("id", "label", *extra))
    return pack, schema


def pack(rows: DataFrame, size: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of at most about twice `size` rows, packed where the rows lie: no shuffle, so no label or id is hot."""
    run, schema = _packed(extra)
    return written(rows.select("id", "label", "v", *extra).mapInArrow(run(size), schema))


def _meet(base: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every block of the base next to every block of anchors of its vector length.

    Blocks of anchors go in lanes of at most `LANE_BLOCKS`, each to as many lanes of the base as there are
    partitions: anchors are copied once per partition, the base once per lane of anchors, which is one until there are
    30,000 anchors.
    """
    spark = base.sparkSession
    wide = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lanes = max(1, math.ceil(anchors.count() / LANE_BLOCKS))
    left = base.withColumn("__b", F.pmod(F.xxhash64("block"), F.lit(wide))).withColumn("__a", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    right = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    right = right.withColumn("__a", F.pmod(F.xxhash64("a_block"), F.lit(lanes)).cast("int"))
    right = right.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide - 1).cast("long")))).withColumnRenamed("a_d", "d")
    return left.join(right.hint("merge"), ["__b", "__a", "d"]).drop("__b").withColumnRenamed("__a", "lane")


class _Block:
    """A block of the base in a task: columns as doubles, and the smallest and largest number of each."""

    def __init__(self, row: dict):
        self.name, self.d, self.kind = row["block"], row["d"], row["kind"]
        self.columns = np.frombuffer(row["columns"], row["kind"]).reshape(row["d"], row["rows"]).astype(np.float64)
        self.ids, self.labels = np.frombuffer(row["id"], "<i8"), np.frombuffer(row["label"], "<i8")
        self.low, self.high = self.columns.min(axis=1, initial=np.inf), self.columns.max(axis=1, initial=-np.inf)

    def whole_scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores as Python's whole numbers, for components so large that doubles would round their sums; none beyond a long."""
        a = [int(x) for x in anchor]
        sums = (sum(x * int(y) for x, y in zip(a, self.columns[:, r], strict=True)) for r in rows)
        return np.array([max(-_LONG - 1, min(_LONG, s)) for s in sums], dtype=object)


def _scan(block: _Block, anchor: np.ndarray, rows: np.ndarray, alive) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of those that `alive(low, high)` lets through to the end, given their bounds after each stride."""
    with np.errstate(over="ignore"):
        reach = np.abs(anchor) @ np.maximum(np.abs(block.low), np.abs(block.high)) if block.d else 0.0
    if not reach < EXACT:
        scores = block.whole_scores(anchor, rows)
        kept = alive(scores, scores)
        return rows[kept], scores[kept]
    order = np.argsort(-np.abs(anchor), kind="stable")
    a = anchor[order]
    ends = np.minimum(a * block.low[order], a * block.high[order]), np.maximum(a * block.low[order], a * block.high[order])
    rest = [np.r_[np.cumsum(e[::-1])[::-1], 0.0] for e in ends]
    part = np.zeros(len(rows))
    for i in range(0, len(a), STRIDE):
        if not len(rows):
            break
        some = order[i : i + STRIDE]
        part += a[i : i + STRIDE] @ block.columns[np.ix_(some, rows)]
        left = min(i + STRIDE, len(a))
        kept = alive(part + rest[0][left], part + rest[1][left])
        if not kept.all():
            rows, part = rows[kept], part[kept]
    if not block.d:
        kept = alive(part, part)
        rows, part = rows[kept], part[kept]
    return rows, part


class _Best:
    """The best `k` (score, id) of one anchor or window so far, higher scores first, ties by smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    def floor(self) -> float | int | None:
        return self.scores[-1] if len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k], int)
        self.scores, self.ids = scores[order], ids[order]


def _kth(values: np.ndarray, k: int):
    """The k-th largest value, or None where there are fewer."""
    if len(values) < k:
        return None
    return np.partition(values, len(values) - k)[len(values) - k] if values.dtype != object else sorted(values)[-k]


def _higher(a, b):
    return b if a is None else a if b is None else max(a, b)


def _positives(block: _Block, anchor: np.ndarray, name: int, label: int, best: _Best) -> None:
    rows = np.flatnonzero((block.labels == label) & (block.ids != name))

    def alive(low, high):
        floor = _higher(best.floor(), _kth(low, best.k))
        return np.ones(len(low), bool) if floor is None else np.asarray(high >= floor, bool)

    if len(rows):
        rows, scores = _scan(block, anchor, rows, alive)
        best.add(scores, block.ids[rows])


def _negatives(block: _Block, anchor: np.ndarray, label: int, windows: list[tuple[int, int, _Best]]) -> None:
    rows = np.flatnonzero(block.labels != label)

    def alive(low, high):
        out = np.zeros(len(low), bool)
        for bottom, top, best in windows:
            inside = low[np.asarray((low >= bottom) & (high <= top), bool)]
            floor = _higher(best.floor(), _kth(inside, best.k))
            out |= np.asarray((high >= (bottom if floor is None else max(bottom, floor))) & (low <= top), bool)
        return out

    if len(rows) and windows:
        rows, scores = _scan(block, anchor, rows, alive)
        for bottom, top, best in windows:
            inside = np.asarray((scores >= bottom) & (scores <= top), bool)
            if inside.any():
                best.add(scores[inside], block.ids[rows[inside]])


def _anchors(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    columns = np.frombuffer(row["a_columns"], row["a_kind"]).reshape(row["d"], row["a_rows"]).astype(np.float64)
    return columns, *(np.frombuffer(row[f"a_{c}"], "<i8") for c in ("id", "label", "number"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, dict]]:
    """Pairs of blocks; a base block next to several blocks of anchors is unpacked once."""
    last: _Block | None = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names if n.startswith("a_") or n in ("block", "d", "lane")}
            if last is None or last.name != row["block"]:
                last = _Block({n: batch.column(n)[i].as_py() for n in ("block", "d", "rows", "kind", "columns", "id", "label")})
            yield last, row


def _out(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def hard_negatives(
    rows: DataFrame,
    anchors: Callable[[Column], Column],
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `anchors` (over key) picks.

    Components become floor(scale * x); a score is the inner product with the anchor. Positives are the first
    `positives` other rows of the anchor's label, negatives the first `negatives` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score; higher scores first, ties by smaller key.
    All rows are compared; nothing is sampled.

    Rows without key, label or vector, or with a component that is null or not finite (times `scale`), take no part.
    Vectors are compared with those of their own length. Repeated rows count one by one, and a row with the anchor's
    key is never its positive; an anchor row repeated as a whole asks once. A score beyond 64 bits counts as the
    nearest long. An empty table or anchors without positives give no rows; other columns are
    ignored, whatever their names.
    """
    told = usable(rows, key, label, vector, scale)
    base = pack(told, BASE_ROWS)
    chosen = told.where(anchors(F.col("id")))
    # numbers are fixed by writing them
    chosen = written(chosen.dropDuplicates(["id", "label", "v"]).withColumn("number", F.monotonically_increasing_id()))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told_of(best: dict[int, _Best]) -> pa.RecordBatch:
            found = [(n, int(v), int(s)) for n, b in best.items() for s, v in zip(b.scores, b.ids, strict=True)]
            return _out(found, ["number", "id", "score"])

        best: dict[int, _Best] = {}
        lane = None
        for block, row in _rows(batches):
            if row["lane"] != lane:  # a lane of anchors at a time
                yield told_of(best)
                best, lane = {}, row["lane"]
            columns, ids, labels, numbers = _anchors(row)
            for i, number in enumerate(numbers.tolist()):
                _positives(block, columns[:, i], ids[i], labels[i], best.setdefault(number, _Best(positives)))
        yield told_of(best)

    met = _meet(base, pack(chosen, ANCHOR_ROWS, ("number",)))
    found = met.mapInArrow(nearest, "number long, id long, score long")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "id"))
    picked = written(found.withColumn("__r", place).where(F.col("__r") <= positives).select("number", "id", "score"))

    scores = picked.groupBy("number").agg(F.collect_set("score").alias("scores"))  # at most `positives` each
    asking = chosen.join(scores, "number")
    for i in range(positives):  # the windows travel as plain columns; missing ones repeat the first
        asking = asking.withColumn(f"w{i}", F.coalesce(F.get("scores", F.lit(i)), F.get("scores", F.lit(0))))
    extra = ("number", *(f"w{i}" for i in range(positives)))

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told_of(best: dict[int, dict[int, tuple[int, int, _Best]]]) -> pa.RecordBatch:
            found = [(n, p, int(v), int(s)) for n, held in best.items() for p, (_, _, b) in held.items() for s, v in zip(b.scores, b.ids, strict=True)]
            return _out(found, ["number", "positive_score", "negative_id", "negative_score"])

        best: dict[int, dict[int, tuple[int, int, _Best]]] = {}
        lane = None
        for block, row in _rows(batches):
            if row["lane"] != lane:
                yield told_of(best)
                best, lane = {}, row["lane"]
            columns, _, labels, numbers = _anchors(row)
            told = np.stack([np.frombuffer(row[f"a_w{i}"], "<i8") for i in range(positives)], axis=1)
            for i, number in enumerate(numbers.tolist()):
                if number not in best:
                    spans = {p: (-(-low * p // 100), high * p // 100) for p in set(told[i].tolist())}
                    best[number] = {p: (a, b, _Best(negatives)) for p, (a, b) in spans.items() if a <= b}
                _negatives(block, columns[:, i], labels[i], list(best[number].values()))
        yield told_of(best)

    met = _meet(base, pack(asking, ANCHOR_ROWS, extra))
    found = met.mapInArrow(windowed, "number long, positive_score long, negative_id long, negative_score long")
    place = F.row_number().over(Window.partitionBy("number", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    hits = found.withColumn("rank", place).where(F.col("rank") <= negatives)
    pairs = picked.select("number", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = chosen.select("number", F.col("id").alias("anchor_id"))
    out = hits.join(pairs, ["number", "positive_score"]).join(named, "number")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
