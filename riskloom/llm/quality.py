"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.words import Block, blocks
from riskloom.plans.frames import written

#: Names of the statistics, in the order of the vector.
STATISTICS = (
    "words", "characters_per_word", "spread_of_word_length", "distinct_words", "adjacent_repeats", "largest_word_share",
    "punctuated_words", "symbol_words", "digits", "capitals", "lines_per_word", "repeated_lines", "longest_line", "stops_per_word",
    "distinct_pairs", "beyond_ascii", "sentence_spread",
)


def _flags(*codes: str) -> np.ndarray:
    table = np.zeros(256, bool)
    for c in codes:
        table[ord(c)] = True
    return table


_STOP = _flags(*".!?")
_POINT = _flags(*".,;:!?")
_DIGIT = _flags(*"0123456789")
_CAPITAL = _flags(*map(chr, range(65, 91)))
_LETTER = _flags(*map(chr, range(48, 58)), *map(chr, range(65, 91)), *map(chr, range(97, 123)))
_LETTER[128:] = True


def _distinct(doc: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(different values, count of the most frequent one) per document."""
    different, most = np.zeros(n), np.zeros(n)
    if len(values):
        order = np.lexsort((values, doc))
        d, v = doc[order], values[order]
        new = np.ones(len(v), bool)
        new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
        starts = np.flatnonzero(new)
        runs = np.diff(np.append(starts, len(v)))
        different = np.bincount(d[starts], minlength=n).astype(float)
        np.maximum.at(most, d[starts], runs)
    return different, most


def statistics(b: Block) -> np.ndarray:
    """One row of transformed statistics per text of a block; rates of an empty text are those of a blank one."""
    n = len(b)
    counts = np.diff(b.bounds).astype(float)
    words = np.maximum(counts, 1)
    doc = np.repeat(np.arange(n), np.diff(b.bounds))
    sizes = np.diff(b.text_begins)
    byte_doc = np.repeat(np.arange(n), sizes)
    size = np.maximum(sizes, 1)

    def per_byte(flags: np.ndarray) -> np.ndarray:
        return np.bincount(byte_doc[flags], minlength=n)

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=n)

    length = (b.ends - b.begins).astype(float)
    mean = per_word(length) / words
    spread = np.sqrt(np.maximum(per_word(length**2) / words - mean**2, 0))
    different, most = _distinct(doc, b.hashes, n)
    same = np.zeros(len(doc), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (b.hashes[1:] == b.hashes[:-1])
    pair = np.zeros(len(doc), np.uint64)
    pair[1:] = b.hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + b.hashes[:-1]
    inner = np.zeros(len(doc), bool)
    inner[1:] = doc[1:] == doc[:-1]
    pairs, _ = _distinct(doc[inner], pair[inner], n)
    point = _POINT[b.data[b.ends - 1]] if len(doc) else np.zeros(0, bool)
    stop = _STOP[b.data[b.ends - 1]] if len(doc) else np.zeros(0, bool)
    letters = np.concatenate([[0], np.cumsum(_LETTER[b.data])])
    symbol = letters[b.ends] == letters[b.begins]
    # lines as runs of words: a line starts with a text or after a line feed
    feeds = np.concatenate([[0], np.cumsum(b.data == 10)])
    line = feeds[b.begins] if len(doc) else np.zeros(0, int)
    starts = np.ones(len(doc), bool)
    starts[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
    at = np.flatnonzero(starts)
    line_words = np.diff(np.append(at, len(doc))).astype(float)
    line_hash = np.add.reduceat(b.hashes * (np.arange(len(doc)).astype(np.uint64) - np.repeat(at, line_words.astype(int)).astype(np.uint64) + np.uint64(1)), at) if len(at) else np.zeros(0, np.uint64)
    line_doc = doc[at]
    lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    line_kinds, _ = _distinct(line_doc, line_hash, n)
    longest = np.zeros(n)
    np.maximum.at(longest, line_doc, line_words)
    # words between stops, the first of a text counted from its own first word
    ends = np.flatnonzero(stop)
    gap_doc = doc[ends]
    before = np.maximum(np.concatenate([[-1], ends[:-1]]) if len(ends) else ends, b.bounds[gap_doc] - 1)
    gap = (ends - before).astype(float)
    gaps = np.maximum(np.bincount(gap_doc, minlength=n), 1)
    gap_mean = np.bincount(gap_doc, weights=np.log1p(gap), minlength=n) / gaps
    gap_var = np.bincount(gap_doc, weights=np.log1p(gap) ** 2, minlength=n) / gaps - gap_mean**2

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Log odds of a share, with half a count on either side."""
        return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))

    return np.column_stack([
        np.log1p(counts), np.log1p(mean), np.log1p(spread), share(different, words), share(per_word(same), words), share(most, words),
        share(per_word(point), words), share(per_word(symbol), words), share(per_byte(_DIGIT[b.data]), size), share(per_byte(_CAPITAL[b.data]), size),
        np.log(lines / words), share(lines - line_kinds, lines), np.log1p(longest), share(per_word(stop), words),
        share(pairs, words), share(per_byte(b.data > 127), size), np.sqrt(np.maximum(gap_var, 0)),
    ])


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and `x`, the statistics of the whole `text`; null texts are empty ones."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "x array<double>"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(b) for b in blocks(batch.column("text"), "space")]
            flat = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
            offsets = pa.array(np.arange(len(batch) + 1) * len(STATISTICS), pa.int32())
            x = pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), x], [*keep, "x"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(measure, schema)


@dataclass
class Discriminant:
    """Means, Cholesky factors of the covariances and log priors of the classes 0 and 1."""

    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    temper: float
    cut: float = 0.0

    def gap(self, x: np.ndarray) -> np.ndarray:
        """Difference of the log densities, priors included, flattened by `temper`."""
        z = (x - self.center) / self.scale
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            u = (z - mean) @ factor
            logs.append(offset - 0.5 * (u**2).sum(axis=1))
        return np.clip((logs[1] - logs[0]) / self.temper, -60, 60)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: half the gap of the Mahalanobis distances plus determinants and priors."""
        return 1 / (1 + np.exp(-np.clip(self.gap(x) - self.cut, -60, 60)))


def class_sums(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class the count, sum and sum of products of `x`, added up in the tasks and then in Spark."""
    d = len(STATISTICS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column("quality").to_numpy(zero_copy_only=False)
            one = np.column_stack([np.ones(len(x)), x])
            for c in (0, 1):
                part = one[y == c]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([(part.T @ part).ravel()])], ["c", "m"])

    cells = labelled.select("x", F.col("quality").cast("int").alias("quality")).mapInArrow(add, "c int, m array<double>")
    rows = cells.select("c", F.posexplode("m").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for c in (0, 1):
        m = np.zeros((d + 1) * (d + 1))
        for r in rows:
            if r.c == c:
                m[r.i] = r.v
        m = m.reshape(d + 1, d + 1)
        out[c] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


def fit(labelled: DataFrame, shrinkage: float = 0.1, ridge: float = 1e-3, temper: float = 4.0) -> Discriminant:
    """Fits on rows (x, quality); only class sums, 18 x 18 numbers each, reach the driver.

    A class covariance is pulled towards the pooled one by `shrinkage`, more so while the class has few rows
    (weight d / (d + rows) is added), and `ridge` goes on the diagonal. A class without rows takes the
    other's shape and mean, so the score is then the prior alone. `temper` flattens the log density gap.
    """
    sums, d = class_sums(labelled), len(STATISTICS)
    rows = sum(s[0] for s in sums.values())
    center = sum(s[1] for s in sums.values()) / max(rows, 1)
    spread = sum(np.diag(s[2]) for s in sums.values()) / max(rows, 1) - center**2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    means, scatter = [], []
    for c in (0, 1):
        n, s, m = sums[c]
        mean = (s / n - center) / scale if n else np.zeros(d)
        raw = (m - np.outer(center, s) - np.outer(s, center) + n * np.outer(center, center)) / np.outer(scale, scale)
        means.append(mean)
        scatter.append(raw - n * np.outer(mean, mean))
    pooled = (scatter[0] + scatter[1]) / max(rows, 1)
    factors, offsets = [], []
    for c in (0, 1):
        n = sums[c][0]
        weight = min(1.0, shrinkage + d / (d + n))
        cov = (1 - weight) * (scatter[c] / n if n else pooled) + weight * pooled + ridge * np.eye(d)
        lower = np.linalg.cholesky((cov + cov.T) / 2)
        factors.append(np.linalg.inv(lower).T)
        offsets.append(float(np.log((n + 1) / (rows + 2)) - np.log(np.diag(lower)).sum()))
    model = Discriminant(center, scale, means, factors, offsets, temper)
    model.cut = _cut(labelled, model) if sums[0][0] and sums[1][0] else 0.0
    return model


def _cut(labelled: DataFrame, model: Discriminant) -> float:
    """The log density gap with the fewest errors on the training rows, in the middle of the best stretch.

    Rows are counted per class and quarter of a unit of the gap, 481 cells at most, before they reach the driver.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            cell = np.floor(model.gap(x) * 4).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int32()), pa.array(cell)], ["c", "cell"])

    counts = np.zeros((2, 482))
    for r in labelled.mapInArrow(place, "c int, cell int").groupBy("c", "cell").count().collect():
        counts[r.c, r.cell + 240] += r["count"]
    # errors of a cut below cell k: good rows in earlier cells, bad ones from k on
    lost = np.concatenate([[0], np.cumsum(counts[1])])
    kept = counts[0].sum() - np.concatenate([[0], np.cumsum(counts[0])])
    best = np.flatnonzero(lost + kept == (lost + kept).min())
    return float((best[0] + best[-1]) / 2 - 240) / 4


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, quality) of labelled rows outside the held-out part; null and other label values are left out."""
    known = labels.where("quality in (0, 1)").select("doc_id", "quality").distinct()
    return measured.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("x", "quality")


def score_rows(measured: DataFrame, model: Discriminant) -> DataFrame:
    """`measured` without `x`, plus score (0 to 1) and predicted (1 from 0.5 on)."""
    names = [c for c in measured.columns if c != "x"]
    schema = ", ".join([*(f"`{c}` {measured.schema[c].dataType.simpleString()}" for c in names), "score double"])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(model.score(x))], [*names, "score"])

    return measured.mapInArrow(rate, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`.

    Scores depend on the text alone. Null and empty texts get the score of an empty text; repeated rows and
    ties score alike; a null doc_id has no label and is scored too; other columns are ignored. Without
    any label every score is 0.5, and an empty table gives no rows.
    """
    measured = written(with_statistics(docs.select("doc_id", "text"), ["doc_id"]))
    model = fit(training_rows(measured, labels))
    return score_rows(measured, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` predicted to be good, columns unchanged."""
    measured = written(with_statistics(docs.select("doc_id", "text"), ["doc_id"]))
    model = fit(training_rows(measured, labels))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # statistics and score in one worker: a text is not sent through two of them
        for batch in batches:
            rows = [model.score(statistics(b)) >= 0.5 for b in blocks(batch.column("text"), "space")]
            if rows:
                yield batch.filter(pa.array(np.concatenate(rows)))

    return docs.mapInArrow(rate, docs.schema)
