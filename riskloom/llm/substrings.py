"""Substring dedup: anchors pick reference passages, suffix automata of their words decide what repeats."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.llm.words import Block, blocks, mix
from riskloom.plans.frames import written

WINDOW = 20
#: Words of an anchor: every window is represented by the least anchor hash inside it.
ANCHOR = 6
#: The filter of repeated anchors has at most 2 ** 27 bits (16 MB); a fuller one only lets more windows through.
MOST_BITS = 27
#: Words per bucket of documents, and per reference shard (automaton) within a bucket.
BUCKET_WORDS, SHARD_WORDS = 1_500_000, 100_000
#: A passage holds the words of the windows that start in one stretch of so many words: one bit of a long each.
CHUNK = 64
#: Anchors or windows a task gathers before it adds equal ones up and sends them on.
GATHERED = 2_000_000
#: An anchor chosen at so many places or more is split: its windows are dealt one by one, by their own hash.
HOT_PLACES = 500_000
_LAST = np.iinfo(np.int64).max


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over values[i : i + width]; entries near the end cover what is left."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def _anchors(b: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor of the window from each word on, True where a window fits, True where an anchor is chosen)."""
    grams, _ = b.windows(ANCHOR)
    _, inside = b.windows(window)
    width = window - ANCHOR + 1
    least = _slide(grams, width, np.minimum)
    chosen = np.where(inside, least, np.uint64(0))
    # a gram is chosen if the largest anchor of the windows around it is the gram itself
    around = _slide(chosen[::-1].copy(), width, np.maximum)[::-1]
    return least, inside, (around == grams) & (around > 0)


def repeated_anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, n, words): anchors chosen at two places or more; the row of a null anchor counts all words."""

    def added_up(picked: list[np.ndarray], words: int) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(picked) if picked else np.zeros(0, np.uint64), return_counts=True)
        anchor = pa.concat_arrays([pa.array(values.view(np.int64)), pa.array([None], pa.int64())])
        counts = pa.array(np.append(n, 0).astype(np.int64))
        total = pa.array(np.append(np.zeros(len(n), np.int64), words))
        return pa.RecordBatch.from_arrays([anchor, counts, total], ["anchor", "n", "words"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked, size, words = [], 0, 0
        for batch in batches:
            for b in blocks(batch.column("text"), "space"):
                grams, _ = b.windows(ANCHOR)
                picked.append(grams[_anchors(b, window)[2]])
                size += len(picked[-1])
                words += len(b.hashes)
            if size >= GATHERED:
                yield added_up(picked, words)
                picked, size, words = [], 0, 0
        yield added_up(picked, words)

    rows = docs.select("text").mapInArrow(count, "anchor bigint, n bigint, words bigint")
    return rows.groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).where("anchor is null or n > 1")


def anchor_filter(repeated: DataFrame, most_bits: int = MOST_BITS) -> tuple[np.ndarray, int]:
    """(bit table of the repeated anchors, bits), indexed by the leading bits of the hash; its size is bounded."""
    count = repeated.where("anchor is not null").count()
    bits = min(most_bits, max(16, int(16 * count + 1).bit_length()))
    place = F.shiftrightunsigned("anchor", 64 - bits) + 1  # the bitmap functions number places from 1
    parts = repeated.where("anchor is not null").groupBy(F.bitmap_bucket_number(place).alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")
    )
    table = np.zeros(max(4096, (1 << bits) // 8), np.uint8)  # one piece of the bitmap at least
    for r in parts.collect():
        piece = np.frombuffer(bytes(r.m), np.uint8)
        at = (r.k - 1) * len(piece)
        table[at : at + len(piece)] = piece
    return table, bits


def _listed(anchors: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """True for anchors that a bit table may hold."""
    place = anchors >> np.uint64(64 - bits)
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def candidate_windows(docs: DataFrame, shared, buckets: int, window: int = WINDOW) -> DataFrame:
    """(b, deal, doc, start, v, n, hashes): stretches of windows over one repeated anchor.

    A stretch holds the hashes of the windows from `start` on that share the anchor; `deal`, by which stretches
    are spread over tasks, is the anchor. Windows over a hot anchor are stretches of one with their own
    hash as `deal`: a phrase that a third of all documents embed in different words fills no single task.
    Equal windows have equal anchors and so one `deal`. Equal stretches of one bucket that a task
    gathers are one row with their number n and their first place. `shared` holds the filters of the repeated and of
    the hot anchors; a full filter takes more anchors for repeated or hot and changes no result.
    """

    def added_up(parts: list[tuple], flat: list[np.ndarray]) -> pa.RecordBatch:
        k, a, w, d, s, v, length, at = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((s, d, w, a, k))
        k, a, w, d, s, v, length, at = (x[order] for x in (k, a, w, d, s, v, length, at))
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (w[1:] != w[:-1])
        pick = np.flatnonzero(new)
        n = np.diff(np.append(pick, len(k)))
        offsets = np.append(0, np.cumsum(length[pick]))
        values = np.concatenate(flat)[np.arange(offsets[-1]) + np.repeat(at[pick] - offsets[:-1], length[pick])]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
        columns = (k[pick].astype(np.int32), a[pick].view(np.int64), d[pick], s[pick].astype(np.int32), v[pick], n.astype(np.int32))
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], ["b", "deal", "doc", "start", "v", "n", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = shared.value
        parts, flat, size = [], [], 0
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            bucket = batch.column("b").to_numpy()
            version = batch.column("v").to_numpy()
            for b in blocks(batch.column("text"), "space"):
                least, inside, _ = _anchors(b, window)
                at = np.flatnonzero(inside & _listed(least, *repeated))
                if not len(at):
                    continue
                hashes = b.windows(window)[0][at]
                alone = _listed(least[at], *hot)
                cut = np.append(0, np.flatnonzero((np.diff(at) != 1) | (np.diff(least[at].view(np.int64)) != 0) | alone[1:]) + 1)
                length = np.diff(np.append(cut, len(at)))
                steps = (np.arange(len(at)) - np.repeat(cut, length)).astype(np.uint64)
                whole = np.add.reduceat(mix(hashes + steps * np.uint64(0x9E3779B97F4A7C15)), cut)
                doc = np.searchsorted(b.bounds, at[cut], "right") - 1
                start = at[cut] - b.bounds[doc]
                deal = np.where(alone[cut], hashes[cut], least[at[cut]])
                row = b.first + doc
                parts.append((bucket[row], deal, whole, ids[row], start, version[row], length, cut + size))
                flat.append(hashes)
                size += len(hashes)
            if size >= GATHERED:
                yield added_up(parts, flat)
                parts, flat, size = [], [], 0
        if parts:
            yield added_up(parts, flat)

    schema = "b int, deal bigint, doc bigint, start int, v int, n int, hashes array<bigint>"
    return _bucketed(docs, buckets).mapInArrow(run, schema)


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """doc (documents without id come last), v (a hash that tells texts of one doc apart), b (bucket) and text."""
    doc, text = F.coalesce("doc_id", F.lit(int(_LAST))), F.coalesce("text", F.lit(""))
    bucket = F.pmod(F.xxhash64(doc, F.hash(text)), F.lit(buckets)).cast("int")
    return docs.select("doc_id", doc.alias("doc"), F.hash(text).alias("v"), bucket.alias("b"), text.alias("text"))


def passages_asked(rows: DataFrame) -> DataFrame:
    """(b, doc, v, chunk, mask): the passages that each bucket has to be compared with.

    `rows` are candidate windows dealt by `deal`. Of equal hashes the first place is asked for by every bucket that
    holds another one; bit i of `mask` is the window that starts at word i of the chunk.
    """
    rows = rows.select("b", "deal", "doc", "v", "n", "start", F.posexplode("hashes").alias("at", "wh"))
    place = F.struct("doc", (F.col("start") + F.col("at")).alias("start"), "v").alias("place")
    rows = rows.select("b", "deal", "wh", "n", place)
    same = W.partitionBy("deal", "wh")
    rows = rows.withColumns({"total": F.sum("n").over(same), "first": F.min("place").over(same)})
    # a row that is the first place and nothing else removes no word
    rows = rows.where((F.col("total") > 1) & ((F.col("n") > 1) | (F.col("place") != F.col("first"))))
    rows = rows.select("b", "first.doc", "first.v", "first.start")
    chunk = F.expr(f"cast(start div {CHUNK} as int)").alias("chunk")
    return rows.groupBy("b", "doc", "v", chunk).agg(F.expr(f"bit_or(shiftleft(1L, start % {CHUNK}))").alias("mask"))


def _passage_key(chunk: Column) -> Column:
    return F.xxhash64("doc", "v").bitwiseXOR(F.shiftleft(chunk.cast("bigint"), 40))


def passages(docs: DataFrame, shared, window: int = WINDOW) -> DataFrame:
    """(doc, v, chunk, words): the words of every passage that the filter `shared` may hold, cut where documents are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = shared.value
        for batch in batches:
            ids, version = batch.column("doc").to_numpy(), batch.column("v").to_numpy()
            keys = batch.column("key").to_numpy().view(np.uint64)
            for b in blocks(batch.column("text"), "space"):
                counts = np.diff(b.bounds)
                pieces = np.where(counts >= window, (counts - window) // CHUNK + 1, 0)
                doc = np.repeat(np.arange(len(counts)), pieces)
                chunk = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                listed = _listed(keys[b.first + doc] ^ (chunk.astype(np.uint64) << np.uint64(40)), table, bits)
                doc, chunk = doc[listed], chunk[listed]
                if not len(doc):
                    continue
                low = b.bounds[doc] + chunk * CHUNK
                high = np.minimum(low + CHUNK + window - 1, b.bounds[doc + 1])
                words = [b" ".join(b.words(i, j)) for i, j in zip(low.tolist(), high.tolist(), strict=True)]
                columns = [ids[b.first + doc], version[b.first + doc], chunk.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(words, pa.binary())], ["doc", "v", "chunk", "words"])

    rows = _bucketed(docs, 1).select("doc", "v", _passage_key(F.lit(0)).alias("key"), "text")
    # rows that repeat a document hold the same passages
    return rows.mapInArrow(run, "doc bigint, v int, chunk int, words binary").distinct()


class SuffixAutomaton:
    """Suffix automaton of a few passages, sequences of words, and their matching statistics."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, passage: list[bytes]) -> None:
        last = 0
        for c in passage:
            last = self._extend(last, c)

    def _clone(self, p: int, q: int, c: bytes) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _extend(self, last: int, c: bytes) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def windows(self, words: list[bytes], size: int) -> list[int]:
        """Per word the state of the `size` words that end there, -1 where the longest match is shorter."""
        follow, link, length = self.next, self.link, self.length
        state, matched, out = 0, 0, []
        for c in words:
            while state and c not in follow[state]:
                state = link[state]
                matched = length[state]
            if c in follow[state]:
                state = follow[state][c]
                matched += 1
            while link[state] >= 0 and length[link[state]] >= size:
                state = link[state]
                matched = length[state]
            out.append(state if matched >= size else -1)
        return out


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of stretches of consecutive numbers."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) != 1)
    return list(zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True))


class Reference:
    """One reference shard: passages in a suffix automaton, and where each of their windows starts."""

    def __init__(self, shard: Block, rows: pa.Table, window: int) -> None:
        """`rows` are the rows of the shard's passages: doc, chunk and mask."""
        mask = rows.column("mask").to_numpy().view(np.uint64)
        passage, bit = np.nonzero((mask[:, None] >> np.arange(CHUNK, dtype=np.uint64)) & np.uint64(1))
        at = shard.bounds[passage] + bit
        fits = at + window <= shard.bounds[passage + 1]
        passage, bit, at = passage[fits], bit[fits], at[fits]
        doc = rows.column("doc").to_numpy()[passage].tolist()
        start = (rows.column("chunk").to_numpy()[passage].astype(np.int64) * CHUNK + bit).tolist()
        self.window, self.automaton = window, SuffixAutomaton()
        self.known = np.unique(shard.windows(window)[0][at])
        runs = _runs(at)
        for low, high in runs:
            self.automaton.add(shard.words(low, high + window))
        self.first: dict[int, tuple[int, int]] = {}
        places = iter(zip(doc, start, strict=True))
        for low, high in runs:
            for state in self.automaton.windows(shard.words(low, high + window), window)[window - 1 :]:
                place = next(places)
                self.first[state] = min(place, self.first.get(state, place))

    def cover(self, b: Block, docs: np.ndarray, hashes: np.ndarray, inside: np.ndarray, steps: np.ndarray) -> None:
        """Adds to `steps` the bounds of the windows of a block that the shard holds from an earlier place.

        Hashes choose the stretches to be matched; equal words have equal hashes, and the automaton decides.
        """
        if not len(self.known):
            return
        spot = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        for low, high in _runs(np.flatnonzero(inside & (self.known[spot] == hashes))):
            i = int(np.searchsorted(b.bounds, low, "right")) - 1
            doc, begin = int(docs[i]), int(b.bounds[i])
            states = self.automaton.windows(b.words(low, high + self.window), self.window)[self.window - 1 :]
            for start, state in enumerate(states, low):
                if state >= 0 and self.first[state] < (doc, start - begin):
                    steps[start] += 1
                    steps[start + self.window] -= 1


def _clean(texts: pa.Table, rows: pa.Table, window: int) -> pa.Table:
    """One bucket: its documents streamed past the automata of the passages it asked for."""
    docs = texts.column("doc").to_numpy()
    parts = []
    for b in blocks(texts.column("text").combine_chunks(), "space"):
        parts.append((b, docs[b.first : b.first + len(b)], *b.windows(window), np.zeros(len(b.hashes) + 1, np.int32)))
    for shard in blocks(rows.column("words").combine_chunks(), "space", block_bytes=SHARD_WORDS * 6):
        reference = Reference(shard, rows.slice(shard.first, len(shard)), window)
        for part in parts:
            reference.cover(*part)
    counts, removed, spans, kept = [], [], [], []
    for b, *_, steps in parts:
        covered = np.cumsum(steps[:-1]) > 0
        for i in range(len(b)):
            gone = covered[b.bounds[i] : b.bounds[i + 1]]
            raw = b.data[b.text_begins[i] : b.text_begins[i + 1]].tobytes().split()
            counts.append(len(gone))
            removed.append(int(gone.sum()))
            spans.append([{"start": s, "end": e + 1} for s, e in _runs(np.flatnonzero(gone))] if removed[-1] else [])
            kept.append(b" ".join(compress(raw, (~gone).tolist()) if removed[-1] else raw).decode())
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.table(
        [texts.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())],
        ["doc_id", "n_words", "n_removed", "spans", "kept"],
    )


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, most_bits: int = MOST_BITS, bucket_words: int = BUCKET_WORDS, hot_places: int = HOT_PLACES
) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed words) and kept (the other words, one space between).

    A word goes when some window of `window` words over it also starts earlier, in a smaller doc_id or before in the
    same document. Equal windows have equal anchors, so only windows over an anchor chosen twice
    are grouped by hash. That only tells which passages a bucket of documents has to be compared with:
    the words of the first places travel to the buckets that hold the same hashes, there they are built into suffix
    automata of bounded shards, and the documents' matching statistics against them give the spans. A word goes only
    where an automaton holds its window, word for word, from an earlier place.

    Null texts have no words and keep nothing. Documents without id come after all others and count as one
    document; rows that repeat a doc_id and text are one document and treated alike. Texts shorter than a
    window stay. Other columns are ignored; an empty table gives no rows.
    """
    repeated = written(repeated_anchors(docs, window))
    words = (repeated.where("anchor is null").select("words").first() or [0])[0]
    buckets = max(1, -(-words // bucket_words))
    filters = (anchor_filter(repeated, most_bits), anchor_filter(repeated.where(F.col("n") >= hot_places), most_bits))
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    # equal windows have equal anchors: stretches are dealt by anchor and taken apart there
    asked = written(passages_asked(candidate_windows(docs, shared, buckets, window).repartition("deal")))
    listed = docs.sparkSession.sparkContext.broadcast(anchor_filter(asked.select(_passage_key(F.col("chunk")).alias("anchor")), most_bits))
    rows = asked.join(passages(docs, listed, window), ["doc", "v", "chunk"]).select("b", "doc", "chunk", "mask", "words")
    texts = _bucketed(docs, buckets).select("doc_id", "doc", "b", "text").groupBy("b")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept string"
    return texts.cogroup(rows.groupBy("b")).applyInArrow(lambda t, r: _clean(t, r, window), schema)
