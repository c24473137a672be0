"""Spelling variants: words one edit apart found in a trie of letter-group counts, grouped under their frequent form.

A word's vector counts its letters by group. One inserted, deleted or replaced letter changes it by a surplus of at
most one and a deficit of at most one. The first levels of the trie are shuffle keys, the others are walked depth
first inside tasks, many words at a time; words that meet in a leaf are compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import lower_ascii
from riskloom.plans.frames import written

#: Letter groups: code points with one remainder, so `a` to `z` have a group each.
GROUPS = 26
#: Levels of the trie that are shuffle keys.
TOP = 4
#: Words of one piece of a subtree, on either side of a comparison.
PIECE = 20_000
#: A subtree of so few words is a leaf bucket: its vectors are compared at once.
BUCKET = 96
#: Elements of a comparison held at once.
CELLS = 1 << 21


def misspelt(runs: Column, key: Column) -> Column:
    """The run without the code point at h % length where 31 divides h, the CRC-32 of `<key>:<run>`; else the run."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), runs))
    at = F.pmod(h, F.length(runs)).cast("int")
    cut = F.concat(F.substring(runs, F.lit(1), at), F.substring(runs, at + 2, F.length(runs)))
    return F.when(F.pmod(h, F.lit(31)) == 0, cut).otherwise(runs)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 7, least: int = 2, noisy: bool = False) -> DataFrame:
    """(word, n): lower-cased runs of Latin letters of at least `shortest` code points with `least` occurrences or more.

    Runs are counted per task before the shuffle, so a very frequent word is a row per task. With `noisy`, runs are
    first changed by `misspelt`. Null texts have no words.
    """
    # a run shorter than the shortest word gives none, with or without a deletion
    runs = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))
    words = docs.select(F.col(key).alias("__key"), F.explode(runs).alias("run"))
    words = words.select((misspelt(F.col("run"), F.col("__key")) if noisy else F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words in one array, and where each word starts; the last start is the end."""
    data = [w.encode("latin-1") for w in words]
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(d) for d in data], out=starts[1:])
    return np.frombuffer(b"".join(data), np.uint8), starts


def _vectors(letters: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Letter counts of each word, one column per group in the order of the levels."""
    n = len(starts) - 1
    word = np.repeat(np.arange(n), np.diff(starts))
    level = np.empty(GROUPS, np.int64)
    level[order] = np.arange(GROUPS)
    counts = np.bincount(word * GROUPS + level[letters % GROUPS], minlength=n * GROUPS)
    return counts.reshape(n, GROUPS).astype(np.int32)


def _meetings(vectors: np.ndarray, stored: np.ndarray, asked: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asked, stored) index pairs whose vectors differ by a surplus and a deficit of at most one each.

    Depth first over the levels from `top`; every node holds the stored words below it and the asked words that can
    still afford to be there, with what they have spent.
    """

    def spent(level: int, value: np.ndarray | int, asking: np.ndarray, more: np.ndarray, less: np.ndarray):
        gap = value - vectors[asking, level]
        return more + np.maximum(gap, 0), less + np.maximum(-gap, 0)

    def visit(level: int, words: np.ndarray, asking: np.ndarray, more: np.ndarray, less: np.ndarray):
        if len(words) > BUCKET and level < GROUPS:
            values = vectors[words, level]
            for value in np.unique(values):
                m, d = spent(level, value, asking, more, less)
                kept = (m <= 1) & (d <= 1)
                if kept.any():
                    yield from visit(level + 1, words[values == value], asking[kept], m[kept], d[kept])
            return
        step = max(1, CELLS // len(words))
        for i in range(0, len(asking), step):
            some = asking[i : i + step]
            # a letter more or less turns the parity of its group: of nearly all pairs this one number decides
            q, w = np.nonzero(np.bitwise_count(parity[some][:, None] ^ parity[words][None, :]) <= 2)
            q, w = some[q], words[w]
            near = np.abs(size[q] - size[w]) <= 1
            q, w = q[near], w[near]
            # with lengths one apart at most, a distance of two is a surplus and a deficit of one at most
            near = np.abs(vectors[q] - vectors[w]).sum(axis=1) <= 2
            if near.any():
                yield q[near], w[near]

    size = vectors.sum(axis=1)
    parity = ((vectors & 1) << np.arange(GROUPS, dtype=np.int32)).sum(axis=1, dtype=np.int32).view(np.uint32)
    more, less = np.zeros(len(asked), np.int32), np.zeros(len(asked), np.int32)
    gap = vectors[stored[:1], :top] - vectors[asked, :top]  # one prefix holds all stored words
    more, less = more + np.maximum(gap, 0).sum(axis=1), less + np.maximum(-gap, 0).sum(axis=1)
    kept = (more <= 1) & (less <= 1)
    if len(stored) and kept.any():
        yield from visit(top, stored, asked[kept], more[kept], less[kept])


def _one_edit(letters: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True where words a[i] and b[i] differ by exactly one inserted, deleted or replaced letter."""
    size = np.diff(starts)
    swap = size[a] > size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    out = np.zeros(len(a), bool)
    by_size = np.argsort(size[b], kind="stable")
    at = 0
    while at < len(a):
        # pairs of like length together, so that one long word does not widen all rows
        width = int(size[b[by_size[at]]])
        rows = by_size[at : at + max(1, CELLS // max(1, width))]
        rows = rows[size[b[rows]] <= max(width + 8, 32)]
        width = int(size[b[rows]].max())
        padded = np.concatenate([letters, np.zeros(width, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, width)
        place = np.arange(width)
        la, lb = size[a[rows]][:, None], size[b[rows]][:, None]
        x, y = view[starts[a[rows]]], view[starts[b[rows]]]
        x[place >= la] = 0
        y[place >= lb] = 0
        unlike = x != y
        first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)[:, None]
        same = (la == lb)[:, 0]
        good = unlike.sum(axis=1) == 1
        longer = np.flatnonzero(~same)
        shifted = (x[longer, :-1] != y[longer, 1:]) & (place[:-1] >= first[longer]) & (place[:-1] < la[longer])
        good[longer] = ((lb - la)[longer, 0] == 1) & ~shifted.any(axis=1)
        out[rows] = good
        at += len(rows)
    return out


def _credits(words: list[str], counts: np.ndarray, who: np.ndarray, other: np.ndarray, rank: np.ndarray):
    """Per word of `who`: how many near words, and the one with the largest count, ties by code points."""
    order = np.lexsort((rank[other], -counts[other], who))
    who, other = who[order], other[order]
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    return who[first], np.diff(np.r_[first, len(who)]), other[first]


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _subtree(words: list[str], counts: np.ndarray, kinds: np.ndarray, order: np.ndarray, top: int) -> pa.RecordBatch | None:
    """Near words of one piece of a subtree. Kinds: 0 stored, 1 the same words asking, 2 words of other subtrees asking."""
    stored, asked = np.flatnonzero(kinds == 0), np.flatnonzero(kinds > 0)
    if not len(stored) or not len(asked):
        return None
    letters, starts = _letters(words)
    rank = np.argsort(np.argsort(np.array([w.encode("latin-1") for w in words], dtype=object), kind="stable"), kind="stable")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def check() -> None:
        if held:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            near = _one_edit(letters, starts, a, b)
            found.append((a[near], b[near]))
            held.clear()

    size = 0
    for q, w in _meetings(_vectors(letters, starts, order), stored, asked, top):
        held.append((q, w))
        size += len(q)
        if size > 1 << 16:
            check()
            size = 0
    check()
    if not found:
        return None
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    foreign = kinds[a] == 2
    # words of one subtree ask each other; a visitor's finding counts for both
    who, other = np.r_[a, b[foreign]], np.r_[b, a[foreign]]
    if not len(who):
        return None
    who, n, best = _credits(words, counts, who, other, rank)
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in who], pa.string()), pa.array(n, pa.int64()), pa.array(counts[best], pa.int64()), pa.array([words[i] for i in best], pa.string())],
        schema=_NEAR,
    )


def _level_order(words: DataFrame) -> np.ndarray:
    """Letter groups from the most to the least frequent in the words: 26 sums, so the first levels split best."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GROUPS, np.int64)
        for batch in batches:
            letters = np.frombuffer("".join(batch.column("word").to_pylist()).encode("latin-1"), np.uint8)
            total += np.bincount(letters % GROUPS, minlength=GROUPS)
        yield pa.RecordBatch.from_pydict({"g": np.arange(GROUPS), "s": total})

    sums = {r["g"]: r["s"] for r in words.select("word").mapInArrow(add, "g long, s long").groupBy("g").agg(F.sum("s").alias("s")).collect()}
    return np.array(sorted(range(GROUPS), key=lambda g: (-(sums.get(g) or 0), g)))


def _dealt(words: DataFrame, order: np.ndarray, top: int) -> DataFrame:
    """(node, kind, word, n): each word stored and asking in its own subtree, and asking in every later one in reach."""
    steps = [np.zeros(top, np.int32)]
    units = np.eye(top, dtype=np.int32)
    steps += [u for u in units] + [-u for u in units] + [u - v for u in units for v in units if (u != v).any()]
    # of two subtrees the words of the lower visit the higher one, so each pair of words meets once
    later = [s for s in steps if tuple(s) > (0,) * top]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            if not words:
                continue
            prefix = _vectors(*_letters(words), order)[:, :top]
            for kind, s in [(0, 0), (1, 0), *((2, s) for s in later)]:
                nodes = prefix + s
                real = np.flatnonzero((nodes >= 0).all(axis=1))
                names = ["-".join(map(str, row)) for row in nodes[real].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(np.full(len(real), kind, np.int32)), batch.column("word").take(pa.array(real)), batch.column("n").take(pa.array(real))],
                    ["node", "kind", "word", "n"],
                )

    return words.select("word", "n").mapInArrow(deal, "node string, kind int, word string, n long")


def near_words(words: DataFrame, top: int = TOP, piece: int = PIECE) -> DataFrame:
    """(word, n_near, best_n, best) of the words with at least one word exactly one edit away; `words` is (word, n), unique.

    A subtree is compared in pieces of about `piece` words on either side, dealt by hash, so a hot one is spread over
    tasks and none holds more than two pieces. Found pairs are added up inside their task.
    """
    order = _level_order(words)
    dealt = written(_dealt(words, order, top))
    pieces = F.ceil(F.sum("m") / piece).cast("int")
    sizes = dealt.groupBy("node", (F.col("kind") == 0).alias("stored")).agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.groupBy("node").agg(
        F.ceil(F.max(F.when(F.col("stored"), F.col("m"))) / piece).cast("int").alias("ns"),
        F.ceil(F.max(F.when(~F.col("stored"), F.col("m"))) / piece).cast("int").alias("na"),
    )
    sizes = written(sizes.where("ns > 0 AND na > 0"))  # subtrees without words of their own are not visited
    mine, theirs = F.when(F.col("kind") == 0, F.col("ns")).otherwise(F.col("na")), F.when(F.col("kind") == 0, F.col("na")).otherwise(F.col("ns"))
    own = F.pmod(F.xxhash64("word"), mine).cast("int")
    placed = dealt.join(sizes, "node").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), theirs - 1)))
    key = F.concat_ws("/", "node", F.when(F.col("kind") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("kind") == 0, F.col("other")).otherwise(F.col("own")))
    rows = placed.select(key.alias("key"), "kind", "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held)
                held.clear()
                done = _subtree(table["word"].to_pylist(), table["n"].to_numpy(), table["kind"].to_numpy(), order, top)
                if done is not None:
                    yield done

        for batch in batches:
            keys = batch.column("key").to_pylist()
            if not keys:
                continue
            cuts = [0, *(i for i, (x, y) in enumerate(pairwise(keys), 1) if x != y), len(keys)]
            for i, j in pairwise(cuts):
                if keys[i] != at:
                    yield from flush()
                    at = keys[i]
                held.append(batch.slice(i, j - i))
        yield from flush()

    spread = rows.repartition("key").sortWithinPartitions("key")
    found = spread.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links that never go round: forms are followed by doubling, each step on narrow rows."""
    forms = written(links.select("word", F.col("form").alias("root")))
    while True:
        on = forms.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        step = written(forms.join(on, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")))
        if not step.where("__moved").limit(1).collect():
            return step.select("word", "root")
        forms = step.select("word", "root")


def group_variants(words: DataFrame, factor: int = 10, top: int = TOP, piece: int = PIECE) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word under its frequent near word.

    `words` is (word, n) with unique words of Latin letters up to U+00FF. A word's form is its near word of largest n
    (ties: smallest in code-point order) if that n is at least `factor` times the word's; its root is where the forms
    end. As n grows by the factor with every form, chains are short and never go round. No words, no rows.
    """
    if factor < 2:
        raise ValueError("a factor under 2 could lead forms round")
    words = written(words.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(words, top, piece)
    known = F.col("best_n") >= F.col("n") * factor
    joined = words.join(near, "word", "left").select(
        "word", F.when(known, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(known, F.col("best_n")).alias("form_n")
    )
    joined = written(joined)
    roots = _roots(joined.where("form IS NOT NULL"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def rewrite(docs: DataFrame, groups: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word, root, times): per document the words that a corpus editor would replace by their root."""
    changed = groups.where("form IS NOT NULL").select("word", "root")
    runs = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))
    held = docs.select(F.col(key).alias("__key"), F.explode(runs).alias("word")).groupBy("__key", "word").agg(F.count(F.lit(1)).alias("times"))
    return held.join(changed, "word").select(F.col("__key").alias(key), "word", "root", "times")
