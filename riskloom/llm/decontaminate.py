"""Benchmark decontamination: a broadcast set of normalised item windows, looked up in every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.words import Block, blocks
from riskloom.plans.frames import written

#: Windows broadcast at once (about 100 bytes each); a larger benchmark is looked up in several passes.
MOST_WINDOWS = 500_000
_BITS = 22


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, n, window): distinct windows of `size` words, or all words of a shorter item; text in lower case."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, column = batch.column("item").to_pylist(), batch.column("text")
            for b in blocks(column, "alnum", lower=True):
                rows = []
                for i in range(len(b)):
                    words = [b.word(j) for j in range(b.bounds[i], b.bounds[i + 1])]
                    n = min(size, len(words))
                    rows += [(items[b.first + i], n, w) for w in {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1 if n else 0)}]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.binary()))], ["item", "n", "window"])

    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return texts.mapInArrow(cut, "item string, n int, window binary").distinct()


class WindowSet:
    """Windows of one length, sorted by hash, with a bit table in front and the items of each window."""

    def __init__(self, n: int, entries: list[tuple[bytes, list[str]]]):
        column = pa.array([w for w, _ in entries], pa.binary()).cast(pa.string())
        hashes = np.zeros(len(entries), np.uint64)
        for b in blocks(column, "alnum"):
            h, inside = b.windows(n)
            hashes[b.first : b.first + len(b)] = h[inside]
        order = np.argsort(hashes, kind="stable")
        self.n, self.hashes = n, hashes[order]
        self.windows = [entries[i][0] for i in order]
        self.items = [entries[i][1] for i in order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.hashes >> np.uint64(64 - _BITS)] = True

    def hits(self, block: Block) -> list[tuple[int, list[str]]]:
        """(first word, items) of the windows of a block that are in the set, verified word by word."""
        h, inside = block.windows(self.n)
        at = np.flatnonzero(inside & self.bits[h >> np.uint64(64 - _BITS)])
        spot = np.searchsorted(self.hashes, h[at])
        ok = spot < len(self.hashes)
        at, spot = at[ok], spot[ok]
        same = self.hashes[spot] == h[at]
        out = []
        for i, s in zip(at[same].tolist(), spot[same].tolist(), strict=True):
            words = b" ".join(block.word(j) for j in range(i, i + self.n))
            while s < len(self.hashes) and self.hashes[s] == h[i]:
                if self.windows[s] == words:
                    out.append((i, self.items[s]))
                s += 1
        return out


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """`docs` plus n_words, `hits` (start, end in words) and `items` (ids of the benchmark items found).

    Words are runs of ASCII letters and digits or characters beyond ASCII, A-Z in lower case. A window is
    `size` consecutive item words, or a whole shorter item. Windows are counted first: up to `most_windows`
    are broadcast, more are looked up in as many passes as it takes, each pass written before the next
    broadcast, so memory is bounded for any benchmark. Null texts have no words; items without words or
    without an id find nothing to name (an id-less item still hits). Repeated rows are treated alike, other
    columns are kept, equally named ones replaced; empty tables give empty results or no hits.
    """
    columns = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    grams = written(item_windows(benchmark, size).groupBy("n", "window").agg(F.sort_array(F.collect_set("item")).alias("items")))
    passes = max(1, -(-grams.count() // most_windows))
    found = docs.select(*columns, F.lit(None).cast("bigint").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    for k in range(passes):
        part = grams.where(F.pmod(F.xxhash64("window"), F.lit(passes)) == k).toPandas()
        sets = [WindowSet(int(n), list(zip(g["window"].map(bytes), g["items"].map(list), strict=True))) for n, g in part.groupby("n")]
        shared = docs.sparkSession.sparkContext.broadcast(sets)
        found = _look(found, shared)
        if k + 1 < passes:
            found = written(found)
            shared.unpersist()
    return found


def _look(found: DataFrame, shared) -> DataFrame:
    names = found.columns

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            counts = np.zeros(len(batch), np.int64)
            hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for b in blocks(text, "alnum", lower=True):
                counts[b.first : b.first + len(b)] = np.diff(b.bounds)
                for windows in shared.value:
                    for at, named in windows.hits(b):
                        doc = int(np.searchsorted(b.bounds, at, "right")) - 1
                        start = at - int(b.bounds[doc])
                        hits[b.first + doc].append({"start": start, "end": start + windows.n})
                        items[b.first + doc] += named
            spans = pa.array([_union(h) for h in hits], batch.schema.field("hits").type)
            ids = pa.array([sorted(set(x)) for x in items], batch.schema.field("items").type)
            new = {"n_words": pa.array(counts), "hits": spans, "items": ids}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)

    return found.mapInArrow(look, found.schema)


def _union(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def remove_spans(scanned: DataFrame) -> DataFrame:
    """`scanned` with the hit words and what lies between them cut out of `text`; the rest is unchanged."""
    names = scanned.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, hits = batch.column("text"), batch.column("hits").to_pylist()
            out = text.to_pylist()
            for b in blocks(text, "alnum", lower=True):
                for i in range(len(b)):
                    if spans := hits[b.first + i]:
                        base, raw = int(b.text_begins[i]), out[b.first + i].encode()
                        for s in reversed(spans):
                            begin, end = b.begins[b.bounds[i] + s["start"]], b.ends[b.bounds[i] + s["end"] - 1]
                            raw = raw[: begin - base] + raw[end - base :]
                        out[b.first + i] = raw.decode()
            new = pa.array(out, text.type)
            yield pa.RecordBatch.from_arrays([new if n == "text" else batch.column(n) for n in names], names)

    return scanned.mapInArrow(cut, scanned.schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of `docs` without any benchmark window, columns unchanged."""
    return scan(docs, benchmark, size).where(F.size("hits") == 0).select(*docs.columns)


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of scanned rows."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["end"] - h["start"])
    return scanned.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
