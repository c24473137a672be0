"""MinHash near-duplicates: an inverted join on signature coordinates with prefix and skip merging."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import components
from riskloom.llm.words import Block, blocks
from riskloom.plans.frames import written

SHINGLE = 5
#: Coordinates of a signature, and how many must agree. Pairs at a similarity of 0.75 agree in 48 on average
#: with a deviation of 3.5, so 30 loses about one such pair in ten million.
COORDINATES, MATCH = 64, 30
#: A family of more documents or shingles than this is compared block by block.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000
_COLUMNS = 4096

_SEEDS = np.random.default_rng(20_240_501)
_A = (_SEEDS.integers(0, 1 << 31, COORDINATES) * 2 + 1).astype(np.uint32)
_B = _SEEDS.integers(0, 1 << 32, COORDINATES).astype(np.uint32)


def shingles(block: Block, windows: np.ndarray, i: int) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of text i; of all its words if they are fewer."""
    low, high = block.bounds[i], block.bounds[i + 1]
    if high - low >= SHINGLE:
        return np.unique(windows[low : high - SHINGLE + 1])
    return np.array([block.whole(i)] if high > low else [], np.uint64)


def signature(values: np.ndarray) -> np.ndarray:
    x = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 8192):
        np.minimum(least, (_A[:, None] * x[None, at : at + 8192] + _B[:, None]).min(axis=1), out=least)
    return least.view(np.int32)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the whole shingle set and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for b in blocks(batch.column("text"), "space", lower=True):
                windows, _ = b.windows(SHINGLE)
                sets = [shingles(b, windows, i) for i in range(len(b))]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(b.first, len(b)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.array([signature(s) for s in sets], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "n_shingles", "digest", "signature"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, signature array<int>")


def families(classes: DataFrame, match: int = MATCH) -> DataFrame:
    """(leader, rep): documents that share a posting list of the coordinate index with its leader.

    Every set is posted under its 64 (coordinate, value) pairs. Values of one set only are skipped at once: a
    document with fewer than `match` shared values has no partner. Of the others it keeps the rarest
    prefix, so long that two documents agreeing `match` times meet in at least one list. All lists of a
    family have mostly one member in common, the one with the most and longest lists: it leads each list, and lists under
    one leader merge to one family instead of being joined pair by pair. Two documents that share a list
    are thus both in its leader's family. `collisions` counts the lists a document shares with the leader.
    """
    key = F.shiftleft(F.col("at").cast("long"), 32) + F.expr("value & 4294967295L")
    postings = classes.select("rep", F.posexplode("signature").alias("at", "value")).select("rep", key.alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    lists = postings.join(shared, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("lists"), F.sum("df").alias("hub"))
    prefix = F.slice("lists", F.lit(1), F.size("lists") - match + 1)
    kept = written(lists.where(F.size("lists") >= match).select("rep", "hub", F.transform(prefix, lambda p: p["key"]).alias("keys")))
    posted = kept.select("rep", "hub", F.explode("keys").alias("key"))
    leaders = posted.groupBy("key").agg(F.max(F.struct("hub", (-F.col("rep")).alias("minus"))).alias("m"), F.count("*").alias("n")).where("n > 1")
    leaders = leaders.select("key", (-F.col("m.minus")).alias("leader"))
    return posted.join(leaders, "key").groupBy("leader", "rep").agg(F.count("*").alias("collisions"))


def _collisions(signed: np.ndarray) -> np.ndarray:
    """Pairs of rows x rows: in how many coordinates their signatures agree."""
    out = np.zeros((len(signed), len(signed)), np.uint8)
    for column in np.ascontiguousarray(signed.T):
        out += column[:, None] == column[None, :]
    return out


def _links(table: pa.Table, match: int) -> pa.Table:
    """A spanning forest of the links within a block, or between two blocks, of a family.

    Collisions are counted first: full sets are compared only of documents with a pair at `match` or more, and
    only such pairs can be linked.
    """
    reps = table.column("rep").to_numpy()
    _, first = np.unique(reps, return_index=True)
    table = table.take(pa.array(first))
    side = table.column("side").to_numpy()
    signed = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.int32).reshape(len(first), COORDINATES)
    candidates = _collisions(signed) >= match
    np.fill_diagonal(candidates, False)
    if side.min() != side.max():
        candidates &= side[:, None] != side[None, :]
    some = np.flatnonzero(candidates.any(axis=1))
    if not len(some):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    table, candidates = table.take(pa.array(some)), candidates[np.ix_(some, some)]
    reps = table.column("rep").to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    values, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # only shingles of two sets or more can be common to a pair
    column = np.cumsum(often > 1) - 1
    keep = often[place] > 1
    rows, columns = rows[keep], column[place[keep]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int((often > 1).sum()), _COLUMNS):
        low, high = np.searchsorted(columns, [at, at + _COLUMNS])
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[rows[low:high], columns[low:high] - at] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    linked = candidates & (4 * common >= 3 * (sizes[:, None] + sizes[None, :] - common))
    seen, edges = np.zeros(len(sets), bool), []
    for root in range(len(sets)):
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(linked[x] & ~seen)
            seen[new] = True
            todo += new.tolist()
            edges += [(reps[x], reps[y]) for y in new]
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def links(docs: DataFrame, classes: DataFrame, match: int = MATCH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links between classes (`rep`, their numbers) that connect what is linked, each confirmed on the full sets.

    Sets of members are built anew from their texts, which are shuffled once. A large family is dealt to
    blocks by hash; every pair of blocks is a task of its own with bounded memory. Links inside a group are not
    listed, each task returns the spanning forest of its own.
    """
    members = written(families(classes, match).join(classes.select("rep", "n"), "rep"))
    sizes = members.groupBy("leader").agg(F.count("*").alias("rows"), F.sum("n").alias("total")).where("rows > 1")
    parts = F.greatest(F.ceil(F.col("rows") / block_rows), F.ceil(F.col("total") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    places = members.join(sizes.select("leader", parts.alias("parts")), "leader")
    places = places.groupBy("rep").agg(F.collect_list(F.struct("leader", "parts")).alias("places"))
    places = written(places.join(classes.select("rep", "doc", "digest"), "rep"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("leader", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("rep", pa.int64()), ("signature", pa.binary()), ("shingles", pa.binary())]
        for batch in batches:
            reps, digests, places = (batch.column(c).to_pylist() for c in ("rep", "digest", "places"))
            for b in blocks(batch.column("text"), "space", lower=True):
                windows, _ = b.windows(SHINGLE)
                rows = []
                for i in range(len(b)):
                    k = b.first + i
                    values = shingles(b, windows, i)
                    if _digest(values) != digests[k]:
                        continue
                    signed, raw = signature(values).tobytes(), values.tobytes()
                    for p in places[k]:
                        own = hash((reps[k], p["leader"])) % p["parts"]
                        for other in range(p["parts"]):
                            low, high = min(own, other), max(own, other)
                            rows.append((p["leader"], low, high, int(own == high), reps[k], signed, raw))
                            if len(rows) >= 1000:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])
                                rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    # merged at every size: members grow with the documents, so they are never broadcast
    texts = docs.select("doc_id", "text").join(places.hint("merge"), docs["doc_id"] == places["doc"]).select("rep", "digest", "places", "text")
    dealt = texts.mapInArrow(deal, "leader bigint, i int, j int, side int, rep bigint, signature binary, shingles binary")
    return dealt.groupBy("leader", "i", "j").applyInArrow(lambda t: _links(t, match), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, match: int = MATCH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs`.

    A row's set holds its distinct five-word shingles in lower case, or all its words if they are fewer. Equal
    sets are one class from the start, so copies cost one row each. Classes are linked when their sets have a
    similarity of 0.75 or more; component_id is the smallest doc_id reachable.

    Null and blank texts have an empty set and link with nothing. A row without doc_id has a null component
    and is kept. Rows repeating a doc_id are one node of the graph, each judged by its own text: what any of them
    links with is in one component. Other
    columns are ignored; an empty table gives no rows.
    """
    signed = written(sign(docs))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    # numbered, as classes of different texts may have the same smallest doc_id
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()))
    key = F.xxhash64("digest")
    repeated = full.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(key).alias("low"), F.max(key).alias("high")).where("rows > 1")
    repeated = written(repeated)
    texts = docs.select("doc_id", "text")
    if repeated.head(1):
        # repeats of a row would all be dealt to the same groups
        texts = texts.distinct()
    found = links(texts, classes, match, block_rows)
    number = classes.select("rep", "doc")
    found = found.join(number.select(F.col("rep").alias("a"), F.col("doc").alias("x")), "a").join(number.select(F.col("rep").alias("b"), F.col("doc").alias("y")), "b")
    several = full.join(repeated.where("low <> high").select("doc_id"), "doc_id").select("doc_id", "digest").distinct()
    several = several.join(classes.select("digest", "doc"), "digest").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    roots = components(found.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(several))
    named = classes.select("digest", F.col("doc").alias("rep")).join(roots, F.col("rep") == F.col("node"), "left")
    named = named.select("digest", F.coalesce("root", "rep").alias("low"))
    low = F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id"))
    joined = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").withColumn("component_id", low)
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` without the rows whose document is not the first of its group, columns unchanged."""
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(written(gone), docs["doc_id"] == F.col("__gone"), "left_anti")
