"""Personal data: fixed formats as seeds, contexts scored as a pattern-instance graph, new identifiers from them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.plans.frames import written

#: Order of the kinds where spans start together (fixed by the contract of the query).
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")
_EDGE = ".,;:!?()[]\"'"
SHORTEST = 5


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        low = found.end() if found else at + 1
        if found:
            yield start, low
        at = text.find("@", low)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points of the fixed formats, leftmost and non-overlapping per kind.

    The patterns use possessive repeats: a run of digits that fails from its first digit fails from any
    later one, so no search is longer than the text.
    """
    out = [(s, e, "email") for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _name(word: str, longest: int) -> str:
    """The word as a key of the graph; a long one is its SHA-256 over all of it, so that no two share a key."""
    return word if len(word) <= longest else "#" + hashlib.sha256(word.encode()).hexdigest()


def _context(token: str | None) -> str:
    return _name(_DIGITS.sub("0", token.lower()), 64) if token else ""


def mentions(text: str, spans: list[tuple[int, int, str]]) -> list[dict]:
    """Identifiers with their neighbour words: every base span, and every other token with a digit or `@`.

    Other tokens count from `SHORTEST` characters on, stripped of marks at their ends: shorter ones are years, counts
    and list numbers, and no identifier is.
    """
    if not spans and not _DIGITS.search(text) and "@" not in text:
        return []
    out, tokens = [], [m.span() for m in _TOKEN.finditer(text)]
    k, covered = 0, 0
    for i, (start, end) in enumerate(tokens):
        while k < len(spans) and spans[k][0] < end:
            s, e, kind = spans[k]
            if s >= start:
                j = i
                while j < len(tokens) and tokens[j][0] < e:
                    j += 1
                right = text[slice(*tokens[j])] if j < len(tokens) else None
                left = text[slice(*tokens[i - 1])] if i else None
                out.append({"left": _context(left), "right": _context(right), "token": _name(text[s:e], 128), "start": s, "end": e, "kind": kind})
            covered = max(covered, e)
            k += 1
        word = text[start:end]
        if start >= covered and ("@" in word or _DIGITS.search(word)):
            inner = word.strip(_EDGE)
            if len(inner) >= SHORTEST:
                s = start + word.index(inner)
                left = text[slice(*tokens[i - 1])] if i else None
                right = text[slice(*tokens[i + 1])] if i + 1 < len(tokens) else None
                out.append({"left": _context(left), "right": _context(right), "token": _name(inner, 128), "start": s, "end": s + len(inner), "kind": None})
    return out


_SPAN = "array<struct<start:int,end:int,kind:string>>"
_MENTION = "array<struct<left:string,right:string,token:string,start:int,end:int,kind:string>>"


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text), base spans and mentions of every row; null texts are empty."""
    schema = f"doc_id bigint, text_key bigint, base {_SPAN}, mentions {_MENTION}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, seen = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                spans = base_spans(text)
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
                seen.append(mentions(text, spans))
            ints, word = pa.int32(), pa.string()
            span = pa.list_(pa.struct([("start", ints), ("end", ints), ("kind", word)]))
            mention = pa.list_(pa.struct([("left", word), ("right", word), ("token", word), ("start", ints), ("end", ints), ("kind", word)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(base, span), pa.array(seen, mention)], ["doc_id", "text_key", "base", "mentions"]
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(read, schema)


def bootstrap(found: DataFrame, rounds: int = 3, confidence: float = 0.9, support: int = 5, doubt: float = 0.25) -> DataFrame:
    """(left, right, token, kind) of identifiers that high-confidence contexts add to the base formats.

    The graph joins contexts (left word, right word) with the identifiers seen in them; copies of a text add
    nothing, as an edge counts once. Seeds hold score 1 for their kind. Each round a context's confidence
    is the sum of its identifiers' scores over their number plus `doubt`, and an unseen identifier's score is
    the mean confidence of its contexts. With the defaults five seeds of one kind carry two unseen identifiers, and
    four seeds carry none. Contexts with `confidence` and at least `support` seeds then give
    their kind to identifiers that score as high. All of it is grouping and joining of edge rows.
    """
    edges = found.select(F.inline("mentions")).groupBy("left", "right", "token").agg(F.max("kind").alias("seed"))
    edges = written(edges)
    sizes = edges.groupBy("left", "right").agg(F.count("*").alias("n"))
    scores = edges.where("seed is not null").select("token", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    contexts = None
    for _ in range(rounds):
        held = edges.join(scores, "token").groupBy("left", "right", "kind").agg(
            F.sum("score").alias("s"), F.sum((F.col("seed") == F.col("kind")).cast("int")).alias("seeds")
        )
        contexts = held.join(sizes, ["left", "right"]).select("left", "right", "kind", (F.col("s") / (F.col("n") + doubt)).alias("confidence"), "seeds")
        contexts = written(contexts)
        places = edges.where("seed is null").select("left", "right", "token")
        total = places.groupBy("token").agg(F.count("*").alias("n"))
        unseen = places.join(contexts, ["left", "right"]).groupBy("token", "kind").agg(F.sum("confidence").alias("s"))
        unseen = unseen.join(total, "token").select("token", "kind", (F.col("s") / F.col("n")).alias("score"))
        seeds = edges.where("seed is not null").select("token", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
        scores = written(seeds.unionByName(unseen))
    sure = contexts.where((F.col("confidence") >= confidence) & (F.col("seeds") >= support))
    high = scores.where(F.col("score") >= confidence)
    return edges.where("seed is null").join(sure, ["left", "right"]).join(high, ["token", "kind"]).select("left", "right", "token", "kind").distinct()


def added_spans(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """(doc_id, text_key, added): the spans of accepted identifiers, for the documents that hold any."""
    places = found.select("doc_id", "text_key", F.inline("mentions")).where("kind is null").drop("kind")
    spans = places.join(accepted, ["left", "right", "token"]).select("doc_id", "text_key", F.struct("start", "end", "kind").alias("s"))
    return spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("s")).cast(_SPAN).alias("added"))


def find(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, text_key, base and added spans of every row of `docs`.

    Null texts are empty and hold nothing. Rows repeating a doc_id and text get the same spans, rows
    repeating only the doc_id each their own. Other columns are ignored; an empty table gives no rows. Texts
    are read whole once; only spans and short contexts are shuffled.
    """
    found = written(extract(docs))
    added = written(added_spans(found, bootstrap(found, **settings)))
    keys = found["doc_id"].eqNullSafe(added["doc_id"]) & (found["text_key"] == added["text_key"])
    none = F.array().cast(_SPAN)
    return found.join(added, keys, "left").select(found["doc_id"], found["text_key"], "base", F.coalesce("added", none).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts per kind, base_sha256 and spans of found rows."""

    def joined(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("r"), s["end"], s["kind"])))
        return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    every = F.concat("base", "added")
    held = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(held) - F.size(F.array_remove(held, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))


def redact(docs: DataFrame, **settings) -> DataFrame:
    """`docs` with every span replaced by its kind in brackets and n_chars, if there, counted anew."""
    found = written(extract(docs))
    added = written(added_spans(found, bootstrap(found, **settings)))
    names = docs.columns
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    added = added.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__k"), F.col("added").alias("__added"))
    joined = keyed.join(added, keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left").select(*names, "__added")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, more in zip(batch.column("text"), batch.column("__added").to_pylist(), strict=True):
                text = value.as_py()
                spans = base_spans(text or "") + [(s["start"], s["end"], s["kind"]) for s in more or ()]
                parts, low = [], 0
                for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
                    if start >= low:
                        parts += [text[low:start], f"[{kind.upper()}]"]
                    low = max(low, end)
                out.append("".join([*parts, text[low:]]) if parts else text)
            new = pa.array(out, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([new if n == "text" else batch.column(n) for n in names], names)

    cleaned = joined.mapInArrow(clean, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else cleaned
