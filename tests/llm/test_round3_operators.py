"""Hard negatives, jump hashing and spelling variants next to brute force, with odd rows."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.llm import bond, shards, variants


# ---- hard negatives ----


def _negatives(rows, anchor, positives=5, negatives=10, low=30, high=90):
    told = [
        (i, l, [math.floor(256 * x) if abs(x) < 2**53 else int(x) * 256 for x in v])
        for i, l, v in rows
        if None not in (i, l, v) and all(x is not None and math.isfinite(256 * x) for x in v)
    ]
    out = []
    for i, l, v in {(i, l, tuple(v)) for i, l, v in told if anchor(i)}:
        scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, m) for j, m, w in told if len(w) == len(v)]
        for less, j in sorted((s, j) for s, j, m in scores if m == l and j != i)[:positives]:
            p = -less
            found = sorted((s, k) for s, k, m in scores if m != l and low * p <= -100 * s <= high * p)[:negatives]
            out += [(i, j, r, k, p, -s) for r, (s, k) in enumerate(found, 1)]
    return sorted(out)


_SCHEMA = "vec_id long, label int, embedding array<double>, id string, v int, score int, lane int"


def _mined(spark, rows, every=20):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], _SCHEMA)
    return sorted(tuple(r) for r in bond.hard_negatives(df, lambda key: key % every == 0).collect())


def _vectors(kind):
    rnd = random.Random(3)
    if kind == "plain":
        return [(i, rnd.randrange(3), [rnd.gauss(0, 1) for _ in range(20)]) for i in range(500)]
    if kind == "ties":
        return [(i, rnd.randrange(3), [float(rnd.randrange(3)) for _ in range(3)]) for i in range(300)]
    if kind == "large":  # sums beyond the exact doubles
        return [(i, i % 3, [rnd.uniform(0.2, 3) * (1e6 if i % 2 else 4e5 if i % 7 else 1e15) for _ in range(3)]) for i in range(60)]
    odd = [[1.0, None, 2.0, 3.0, 4.0], [math.nan] * 5, [math.inf] * 5, [1e307] * 5, None]
    rows = [
        (i if i % 17 else None, rnd.randrange(2) if i % 13 else None, [rnd.gauss(0, 1) for _ in range(5 if i % 3 else 9)] if i % 11 else odd[i % 5])
        for i in range(400)
    ]
    return rows + [(100, 1, [1.0] * 5)] * 4 + [(200, 0, [])] * 2 + [(201, 1, []), (-40, 1, [0.5] * 5)]


@pytest.mark.parametrize("kind", ["plain", "ties", "odd", "large"])
def test_hard_negatives_equal_brute_force(spark, kind):
    rows = _vectors(kind)
    want = _negatives(rows, lambda i: i % 20 == 0)
    assert _mined(spark, rows) == want and want


def test_hard_negatives_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bond, "LANE_BLOCKS", 1)
    monkeypatch.setattr(bond, "BASE_ROWS", 16)
    monkeypatch.setattr(bond, "ANCHOR_ROWS", 4)
    rows = _vectors("ties")
    assert _mined(spark, rows, 7) == _negatives(rows, lambda i: i % 7 == 0)


def test_hard_negatives_of_nothing(spark):
    assert _mined(spark, []) == []
    assert _mined(spark, [(20, 1, [1.0]), (21, 2, [1.0])]) == []  # an anchor without positives


# ---- jump consistent hashing ----


def _jump(key, shards_):
    """The published algorithm, with Python's whole numbers."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards_:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 40, 150])
def test_jump_is_the_published_walk(spark, n):
    keys = [*range(-20, 400), 2**63 - 1, -(2**63), 2**62 + 12345]
    df = spark.createDataFrame([(k, "x") for k in keys], "doc_id long, text string")
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in shards.place(df, n).collect()}
    assert got == {k: (_jump(k, n), _jump(k, n + 1)) for k in keys}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    moved = shards.moves(df, 10, 11).groupBy("to_shard").count().collect()
    assert [r["to_shard"] for r in moved] == [10] and 0.8 < moved[0]["count"] / (20_000 / 11) < 1.2
    assert shards.moves(df, 10, 10).count() == 0
    with pytest.raises(ValueError):
        shards.moves(df, 10, 9)


def test_slots_are_gapless_with_odd_rows(spark):
    texts = ["", None, "é" * 1000, "a b"]
    rows = [(i % 50 if i % 9 else None, texts[i % 4], i, "s") for i in range(600)]
    rows += [(7, "hot", 0, "s")] * 800  # one key and text in more than half of all rows
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int, shard string")
    out = shards.shard(df, 5).collect()
    assert len(out) == len(rows) and all(r["law"] == "key" for r in out)
    for k in range(5):
        mine = sorted((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out if r["shard"] == k)
        assert [r[0] for r in mine] == list(range(len(mine)))
        assert [r[1:] for r in mine] == sorted(r[1:] for r in mine)
    told = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out)
    assert told == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert {r["shard"] for r in out if r["doc_id"] is None} == {_jump(0, 5)}


def test_many_copies_come_back_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(shards, "COPIES_AT_ONCE", 7)
    df = spark.createDataFrame([(1, "x")] * 40, "doc_id long, text string")
    assert sorted(r["slot"] for r in shards.shard(df, 3).collect()) == list(range(40))


def test_shards_of_nothing_and_of_text_keys(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert shards.shard(empty, 4).count() == 0
    df = spark.createDataFrame([(f"k{i}", "t", i) for i in range(300)], "doc_id string, text string, shard int")
    name = shards.write_shards(df, str(tmp_path / "s"), 4, files=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert name == "_shard" and back.count() == 300
    placed = shards.place(df, 4).select("doc_id", F.col("shard").alias("p"))
    assert back.join(placed, "doc_id").where(F.col(name) != F.col("p")).count() == 0
    with pytest.raises(ValueError):
        shards.place(df, 0)


# ---- spelling variants ----


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _grouped(counts):
    form = {}
    for w in counts:
        near = [v for v in counts if _near(v, w)]
        best = min(near, key=lambda v: (-counts[v], v)) if near else None
        known = best is not None and counts[best] >= 10 * counts[w]
        form[w] = (best if known else None, len(near), counts[best] if known else None)

    def root(w):
        while form[w][0] is not None:
            w = form[w][0]
        return w

    return sorted((w, form[w][0] or "", root(w), counts[w], form[w][1], form[w][2]) for w in counts)


def _words():
    rnd = random.Random(5)
    counts = Counter()
    for _ in range(900):
        counts["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 8)))] += rnd.choice([1, 1, 2, 30, 400])
    counts |= Counter({"x" * 70: 5, "x" * 71: 60, "y" * 3000: 9, "y" * 3001: 2, "ÿÀ×": 3, "ÿÀ÷": 40})
    return dict(counts)


@pytest.mark.parametrize(("top", "piece"), [(4, 20_000), (2, 40), (0, 50)])
def test_variants_equal_brute_force(spark, top, piece):
    counts = _words()
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted((r["word"], r["form"] or "", *r[2:]) for r in variants.group_variants(df, top=top, piece=piece).collect())
    assert got == _grouped(counts)


def test_forms_are_followed_to_the_end(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20_000, "zzzzzzz": 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {r["word"]: r["root"] for r in variants.group_variants(df).collect()} == {**{w: "aaabbbb" for w in counts}, "zzzzzzz": "zzzzzzz"}
    with pytest.raises(ValueError):
        variants.group_variants(df, factor=1)
    assert variants.group_variants(df.limit(0)).count() == 0


def test_vocabulary_of_odd_texts(spark):
    long = "abcdefg " * 30_000
    rows = [(1, "Straßen straßen ÀÉÎÕÜÝÿ ÀÉÎÕÜÝÿ x1abcdefgh"), (2, None), (None, "straßen"), (3, ""), (4, long), (4, "short abcdef"), (5, "ĀbcdefgĀ bcdefgh")]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    plain = {r["word"]: r["n"] for r in variants.vocabulary(df).collect()}
    assert plain == {"straßen": 3, "ÀÉÎÕÜÝÿ": 2, "abcdefg": 30_000}

    want = Counter()
    for d, t in rows:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            want[word] += len(word) >= 7
    got = {r["word"]: r["n"] for r in variants.vocabulary(df, least=1, noisy=True).collect()}
    assert got == {w: n for w, n in want.items() if n}


def test_rewrites_name_the_words_to_replace(spark):
    docs = spark.createDataFrame([(1, "colourx Colourx other"), (2, None)], "doc_id long, text string")
    groups = spark.createDataFrame([("colourx", "colours", "colours"), ("colours", None, "colours")], "word string, form string, root string")
    assert [tuple(r) for r in variants.rewrite(docs, groups).collect()] == [(1, "colourx", "colours", 2)]


# ---- mended operators ----


def test_weight_zero_leaves_a_source_out(spark):
    from riskloom.llm import mixing

    rows = [(i, "w " * 20, ("de", "en")[i % 2], f"s{i % 5}") for i in range(200)]
    docs = spark.createDataFrame([(*r, "d", 1, 2.0) for r in rows], "doc_id long, text string, lang string, source string, domain string, n_tokens int, __n double").drop("__n")
    drawn = mixing.mix(docs, share=(1, 2), weights={"lang": {"de": 0}, "source": {"s1": 3}}).collect()
    assert drawn and {r["lang"] for r in drawn} == {"en"}
    total = sum(r["n_tokens"] * r["copies"] for r in drawn)
    assert 1900 <= total <= 2000  # what the zero leaves goes to the others
    assert mixing.mix(docs, weights={"lang": {"de": 0, "en": 0}}).count() == 0
    for bad in (-1, 0.5):
        with pytest.raises(ValueError):
            mixing.mix(docs, weights={"lang": {"de": bad}})


@pytest.mark.parametrize(("seeds", "added"), [(4, 0), (5, 1), (10, 1), (20, 1)])
def test_support_decides_what_a_context_adds(spark, seeds, added):
    from riskloom.llm import pii

    rows = [(i, f"please mail bob{i}@b.com today", "x") for i in range(seeds)] + [(900, "please mail bob(at)b77 today", "x"), (901, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    out = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["added"]] for r in pii.find(docs).collect()}
    assert sum(map(len, out.values())) == added and out[900] == [(12, 22, "email")] * added


def test_long_identifiers_with_one_prefix_are_two(spark):
    from riskloom.llm import pii

    long = "id-7" + "x" * 300
    rows = [(i, f"please mail bob{i}@b.com today") for i in range(30)] + [(100, f"please mail {long}a today"), (101, f"other words {long}b here")]
    rows += [(200 + i, f"{'w' * 100}{i % 2} n{i}@c.org {'v' * 100}") for i in range(30)] + [(300, f"{'w' * 100}2 zz-99-zz {'v' * 100}")]
    out = {r["doc_id"]: len(r["added"]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100] == 1 and out[101] == 0
    # digits of a context are one, so the last row is in a known context; another letter behind the prefix is not
    assert out[300] == 1
    rows[-1] = (300, f"{'w' * 100}x zz-99-zz {'v' * 100}")
    assert {r["doc_id"]: len(r["added"]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}[300] == 0


def test_templates_are_as_deep_as_their_paths(spark):
    from riskloom.llm import urls

    deep = "/".join("abcdefg")
    rules = [("block", "h.org", f"/{deep}/bad/x"), ("allow", "h.org", f"/{deep}/good/x")]
    rows = [(i, f"http://h.org/{deep}/{'bad' if i % 2 else 'good'}/x{'y' * i}") for i in range(40)]
    rows += [(100, f"http://h.org/{deep}/bad/other"), (101, f"http://h.org/{deep}/good/other"), (102, "http://h.org/" + "s/" * 3000 + "t"), (103, None)]
    out = {r["page_id"]: r for r in urls.template_tree(spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, node string"), rules).collect()}
    assert out[100]["verdict"] == "block" and out[101]["verdict"] == "allow"
    assert out[102]["template"] == "/" + "s/" * 3000 + "t" and out[103]["verdict"] in ("allow", "block") and len(out) == 44
