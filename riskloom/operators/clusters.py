"""Choosing a cluster count by Davies-Bouldin or silhouette."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.plans.frames import written


def as_vectors(df: DataFrame, column: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def davies_bouldin(df: DataFrame, features: str, cluster: str) -> float:
    """Mean over clusters of the worst (spread_i + spread_j) / distance_ij.

    Two grouped aggregates leave k centres and k spreads; only those reach the driver.
    """
    centres = df.groupBy(cluster).agg(vector_to_array(Summarizer.mean(F.col(features))).alias("__centre"))
    rows = centres.collect()
    if len(rows) < 2:
        raise ValueError("needs at least two clusters")
    table = F.broadcast(df.sparkSession.createDataFrame(rows, centres.schema))
    squares = F.aggregate(
        F.zip_with(vector_to_array(features), "__centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x
    )
    spread = dict(df.join(table, cluster).groupBy(cluster).agg(F.avg(F.sqrt(squares))).collect())
    keys = [r[cluster] for r in rows]
    points = np.array([r["__centre"] for r in rows])
    worst = []
    for i, a in enumerate(keys):
        # coincident centres count as infinitely far apart
        gaps = {b: math.dist(points[i], points[j]) for j, b in enumerate(keys) if i != j}
        ratios = [(spread[a] + spread[b]) / gap if gap else 0.0 for b, gap in gaps.items()]
        worst.append(max(ratios))
    return float(np.mean(worst))


def silhouette(df: DataFrame, features: str, cluster: str, distance: str = "squaredEuclidean") -> float:
    evaluator = ClusteringEvaluator(featuresCol=features, predictionCol=cluster, distanceMeasure=distance)
    return evaluator.evaluate(df.withColumn(cluster, F.col(cluster).cast("double")))


#: Most rows of a block, and most numbers in its vectors.
SILHOUETTE_BLOCK, SILHOUETTE_NUMBERS = 32_768, 4_194_304
#: Rows of a tile; squared gaps below this share of the squared lengths are taken from differences.
TILE, CLOSE = 256, 1e-4


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of two tiles: by products, and by differences where rows are so near that products lose digits."""
    mine, theirs = (x * x).sum(axis=1), (y * y).sum(axis=1)
    square = (-2.0 * x) @ y.T
    square += mine[:, None]
    square += theirs
    if square.min() < CLOSE * (mine.max() + theirs.max()):
        i, j = np.nonzero(square < CLOSE * (mine[:, None] + theirs))
        for a in range(0, len(i), 16_384):
            at = i[a : a + 16_384], j[a : a + 16_384]
            square[at] = ((x[at[0]] - y[at[1]]) ** 2).sum(axis=1)
    return np.sqrt(square, out=square)


def _gap_sums(x: np.ndarray, mine: np.ndarray, y: np.ndarray, theirs: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of distances by cluster, for the rows of x to those of y and back; `mine` and `theirs` mark clusters with 1."""
    there, back = np.zeros((len(x), theirs.shape[1])), np.zeros((len(y), mine.shape[1]))
    for a in range(0, len(x), TILE):
        for b in range(0, len(y), TILE):
            gap = _gaps(x[a : a + TILE], y[b : b + TILE])
            there[a : a + TILE] += gap @ theirs[b : b + TILE]
            if not same:
                back[b : b + TILE] += gap.T @ mine[a : a + TILE]
    return there, back


def _marks(names: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return (labels[:, None] == names[None, :]).astype(np.float64)


def _wide(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
    return flat.reshape(len(column), -1)


def euclidean_silhouette(df: DataFrame, features: str, cluster: str, most_rows: int | None = None, seed: int = 42) -> float:
    """Mean silhouette with plain distances: (b - a) / max(a, b) per row, 0 in a cluster of one row.

    Each pair of blocks of rows is one group of bounded size that is compared once, for the rows of both, and leaves one sum
    per row and cluster; sums are added up before they are shuffled. All pairs are compared, so the cost grows with the square
    of the rows: `most_rows` takes about that many by a hash of the row's number instead, and the result is theirs.
    """
    rows = df.select(vector_to_array(features).alias("v"), F.col(cluster).cast("string").alias("c")).where("v IS NOT NULL AND c IS NOT NULL")
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()))
    n = rows.count()
    if most_rows and n > most_rows:
        rows = written(rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(math.ceil(n / most_rows))) == 0))
        n = rows.count()
    sizes = rows.groupBy(F.col("c").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    if len(sizes.limit(2).collect()) < 2:
        raise ValueError("needs at least two clusters")
    parallel = df.sparkSession.sparkContext.defaultParallelism
    widest = max(rows.agg(F.max(F.size("v"))).first()[0], sizes.count())  # a row has its numbers and a sum per cluster
    most = min(SILHOUETTE_BLOCK, max(2_048, SILHOUETTE_NUMBERS // max(1, widest)))
    blocks = max(math.ceil(n / most), min(math.ceil(n / min(most, 2_048)), math.ceil(math.sqrt(8 * parallel))))
    tasks = min(4_096, max(blocks * (blocks + 1), parallel))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    spread = rows.select("id", "c", "v", own.alias("own"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return made.empty_table()
        sides = [(t["id"].to_numpy(), t["c"].to_numpy().astype(str), _wide(t["v"])) for t in (a, b)]
        (ids, c, x), (others, d, y) = sides
        mine, theirs = np.unique(c), np.unique(d)
        same = a["p"][0].as_py() == a["q"][0].as_py()
        there, back = _gap_sums(x, _marks(mine, c), y, _marks(theirs, d), same)
        found = [(ids, c, theirs, there)] if same else [(ids, c, theirs, there), (others, d, mine, back)]
        columns = [
            np.concatenate(p)
            for p in zip(*[(np.repeat(i, len(m)), np.repeat(g, len(m)), np.tile(m, len(i)), sums.ravel()) for i, g, m, sums in found])
        ]
        return pa.table([pa.array(v) for v in columns], made)

    # block p meets the blocks from p on
    left = spread.select("id", "c", "v", F.col("own").alias("p"), F.explode(F.sequence("own", F.lit(blocks - 1))).alias("q"))
    right = spread.select("id", "c", "v", F.col("own").alias("q"), F.explode(F.sequence(F.lit(0), "own")).alias("p"))
    left, right = (side.repartition(tasks, "p", "q").groupBy("p", "q") for side in (left, right))
    made = pa.schema([("id", pa.int64()), ("c", pa.string()), ("other", pa.string()), ("s", pa.float64())])
    sums = left.cogroup(right).applyInArrow(run, "id long, c string, other string, s double")
    means = sums.groupBy("id", "c", "other").agg(F.sum("s").alias("s")).join(F.broadcast(sizes), "other")  # a row per cluster
    inside = F.max(F.when(F.col("other") == F.col("c"), F.col("s") / F.nullif(F.col("n") - 1, F.lit(0))))
    outside = F.min(F.when(F.col("other") != F.col("c"), F.col("s") / F.col("n")))
    rated = means.groupBy("id").agg(inside.alias("a"), outside.alias("b"))
    value = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return float(rated.agg(F.avg(F.coalesce(value, F.lit(0.0)))).first()[0])


def cluster_scores(
    df: DataFrame, features: str, min_clusters: int = 2, max_clusters: int = 10, metric: str = "davies_bouldin", seed: int = 42
) -> DataFrame:
    """(clusters, score, best) for every cluster count in the range, by one of `METRICS`."""
    measure = METRICS[metric]
    data = df.select(features).persist()
    scores = []
    try:
        for k in range(min_clusters, max_clusters + 1):
            model = KMeans(featuresCol=features, predictionCol="__cluster", k=k, seed=seed).fit(data)
            out = model.transform(data)
            scores.append((k, float(measure(out, features, "__cluster"))))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(best_score(scores, metric), "clusters int, score double, best boolean")


def best_score(scores: list[tuple[int, float]], metric: str) -> list[tuple[int, float, bool]]:
    """(clusters, score, best): the lowest Davies-Bouldin or the highest silhouette; of equals the first."""
    pick = min if metric == "davies_bouldin" else max
    best = pick(scores, key=lambda s: s[1])[0]
    return [(k, v, k == best) for k, v in scores]


def find_optimal_clusters_db(df: DataFrame, features: str, min_clusters: int = 2, max_clusters: int = 10, seed: int = 42) -> int:
    return cluster_scores(df, features, min_clusters, max_clusters, "davies_bouldin", seed).where("best").first()["clusters"]


def find_optimal_clusters_silhouette(
    df: DataFrame, features: str, min_clusters: int = 2, max_clusters: int = 10, seed: int = 42, metric: str = "silhouette"
) -> int:
    """By squared distances in one pass, or with `metric="silhouette_euclidean"` by plain ones over all pairs."""
    return cluster_scores(df, features, min_clusters, max_clusters, metric, seed).where("best").first()["clusters"]


METRICS = {"davies_bouldin": davies_bouldin, "silhouette": silhouette, "silhouette_euclidean": euclidean_silhouette}
