"""The text operators next to brute force, on invented rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import decontaminate, minhash, pii, quality, substrings, words

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text): originals, exact and near copies, shared passages, odd rows."""
    rng = random.Random(3)
    words = [f"W{i:03d}é" if i % 7 == 0 else f"w{i:03d}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    out = []
    for i in range(40):
        own = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 19, 20, 60, 200]))]
        if i % 4 == 0:
            own[len(own) // 2 : len(own) // 2] = passage
        out.append((i, "  ".join(own) + ("\n" if i % 2 else "")))
    base = out[39][1].split() + [rng.choice(words) for _ in range(150)]
    for i in range(40, 70):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append((i, " ".join(copy).upper() if i % 9 == 0 else " ".join(copy)))
    out += [(70, None), (71, ""), (72, " \t\n"), (73, "one"), (74, "ONE"), (75, "a b c a b c " * 30), (76, "x" * 50_000)]
    out += [(77, " ".join(rng.choice(words) for _ in range(20_000)))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 1.5, 9) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_words double, kept int").repartition(3)


def odd_rows(spark):
    rows = [(None, "some words without an id here"), (5, "same row twice, same row twice"), (5, "same row twice, same row twice"), (6, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_minhash_equals_exact_join(spark, docs, texts):
    sets = {}
    for i, t in texts:
        w = BLANK.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    want = {i: (len(sets[i]), root(i), root(i) == i) for i in sets}
    for block_rows in (512, 8):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, block_rows=block_rows).collect()}
        assert got == want
    assert sum(not w[2] for w in want.values()) > 20


def test_minhash_confirms_pairs_with_enough_collisions():
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(base)]
    for changed in (0, 20, 50, 57, 58, 120, 400):
        other = base.copy()
        other[:changed] = rng.integers(0, 1 << 63, changed)
        sets.append(np.unique(other))
    signed = np.array([minhash.signature(s) for s in sets])
    counts = minhash._collisions(signed)
    assert (counts == (signed[:, None] == signed[None, :]).sum(axis=2)).all()

    def linked(match, sides):
        columns = [range(len(sets)), sides, [s.tobytes() for s in signed], [s.tobytes() for s in sets]]
        table = pa.table(dict(zip(("rep", "side", "signature", "shingles"), map(list, columns), strict=True)))
        out = minhash._links(table, match).to_pydict()
        return list(zip(out["a"], out["b"], strict=True))

    def reached(edges):
        up = list(range(len(sets)))
        for _ in sets:
            for a, b in edges:
                up[a] = up[b] = min(up[a], up[b])
        return up

    def plain(match, sides):
        return [
            (a, b) for a in range(len(sets)) for b in range(a)
            if counts[a, b] >= match and (len(set(sides)) == 1 or sides[a] != sides[b])
            and 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))
        ]

    for sides in ([0] * 8, [0, 1] * 4):
        for match in (1, 30, 60, 64):
            assert reached(linked(match, sides)) == reached(plain(match, sides))
    assert linked(65, [0] * 8) == []


def test_minhash_odd_rows(spark):
    got = sorted(map(tuple, minhash.near_duplicates(odd_rows(spark)).collect()), key=str)
    assert got == [(5, 2, 5, True), (5, 2, 5, True), (6, 0, 6, True), (None, 2, None, True)]
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert minhash.drop_near_duplicates(odd_rows(spark)).count() == 4


def test_minhash_repeated_ids(spark):
    first, second, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    near = [t + " end" for t in (first, second, third)]
    # id 1 holds two texts, each with a near copy; id 9 holds two texts and is the smallest of neither class
    rows = [(1, first), (1, second), (5, near[0]), (6, near[1]), (7, third), (9, third), (8, "one of four words"), (9, "one of four words"), (10, near[2])]
    want = {1: 1, 5: 1, 6: 1, 7: 7, 8: 7, 9: 7, 10: 7}
    for order in (rows, rows[::-1], rows + [(1, first)] * 40):
        docs = spark.createDataFrame(order, "doc_id bigint, text string").repartition(3)
        got = minhash.near_duplicates(docs).collect()
        assert len(got) == len(order) and {(r.doc_id, r.component_id) for r in got} == set(want.items())
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("most_windows", [500_000, 7])
def test_decontaminate_equals_brute_force(spark, docs, texts, most_windows):
    source = dict(texts)
    items = [(1, " ".join(source[8].split()[5:30])), (2, "One"), (3, None), (4, " ".join(source[77].split()[100:109])), (None, "one"), (12, " ".join(source[0].split()[:15]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    grams = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).update([str(i)] if i is not None else [])
    want = {}
    for i, t in texts:
        w, hit, found = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[g]
        want[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    scanned = decontaminate.scan(docs, bench, most_windows=most_windows)
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.digest(scanned).collect()}
    assert got == want
    clean = {r.doc_id: r.text for r in decontaminate.remove_spans(scanned).collect()}
    for i, t in texts:
        left = len(ALNUM.findall((clean[i] or "").translate(LOWER)))
        assert left == want[i][0] - want[i][1]
        assert want[i][4] or clean[i] == t
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {i for i in want if not want[i][4]}


def test_decontaminate_empty(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.digest(decontaminate.scan(docs, none)).where("contaminated").count() == 0
    assert decontaminate.scan(empty(spark), none).count() == 0


@pytest.mark.parametrize(("most_bits", "hot_places"), [(27, 500_000), (4, 500_000), (27, 3), (4, 1)])
def test_substrings_equal_brute_force(spark, docs, texts, most_bits, hot_places):
    seen, want = set(), {}
    for i, t in sorted(texts):
        w = BLANK.findall(t or "")
        gone = bytearray(len(w))
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = b"\1" * 20
            seen.add(g)
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    done = substrings.remove_repeats(docs, most_bits=most_bits, bucket_words=3000, hot_places=hot_places).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in done} == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in done)
    assert sum(x[1] for x in want.values()) > 3000


def test_substrings_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(25))
    rows = spark.createDataFrame([(5, long), (5, long), (None, long), (6, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in substrings.remove_repeats(rows).collect()), key=str)
    assert got == [(5, 0), (5, 0), (6, 0), (None, 25)]
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_substrings_of_equal_hashes_are_matched_by_their_words(monkeypatch):
    """Where every window has one hash, the automata alone decide: nothing but true repeats goes."""
    rng = random.Random(7)
    source = [f"w{rng.randrange(50)}" for _ in range(150)]
    texts = [[f"u{i}" for i in range(80)], ["a", *source[30:70], "b", "c"], source[:19], ["d"] * 30]
    chunks = [(0, " ".join(source[:83])), (1, " ".join(source[64:147]))]
    rows = pa.table([
        pa.array([1, 1], pa.int64()), pa.array([c for c, _ in chunks], pa.int32()),
        pa.array([-1, -1], pa.int64()), pa.array([t.encode() for _, t in chunks], pa.binary()),
    ], ["doc", "chunk", "mask", "words"])
    held = pa.table([pa.array([5, 6, 7, 8]), pa.array([5, 6, 7, 8]), pa.array([" ".join(t) for t in texts])], ["doc_id", "doc", "text"])
    want = {5: [], 6: [{"start": 1, "end": 41}], 7: [], 8: []}
    for forge in (False, True):
        if forge:
            windows = words.Block.windows
            monkeypatch.setattr(words.Block, "windows", lambda b, n: (np.full(len(b.hashes), 9, np.uint64), windows(b, n)[1]))
        got = substrings._clean(held, rows, 20).to_pylist()
        assert {r["doc_id"]: r["spans"] for r in got} == want
    # a passage from a later place, or from the place itself, removes nothing
    late = held.set_column(1, "doc", pa.array([1, 0, 1, 0]))
    assert all(r["n_removed"] == 0 for r in substrings._clean(late, rows, 20).to_pylist())


def test_substrings_of_one_id_with_several_texts(spark):
    """Texts that share a doc_id, or have none, are told apart by place and by text, in every bucket."""
    def run(c, n=70):
        return " ".join(f"{c}{i}" for i in range(n))

    rows = [(1, run("a")), (1, run("b")), (2, "x " + run("b")), (None, run("c")), (None, "y " + run("c")), (None, run("a")), (None, run("d"))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for bucket_words in (1_500_000, 40):
        got = substrings.remove_repeats(frame, bucket_words=bucket_words).collect()
        assert sorted((r.doc_id or 0, r.kept[:2], r.n_removed) for r in got) == sorted(
            [(1, "a0", 0), (1, "b0", 0), (2, "x", 70), (0, "c0", 0), (0, "y", 70), (0, "", 70), (0, "d0", 0)]
        )


def test_suffix_automaton_matches():
    rng = random.Random(1)
    passages = [[rng.randrange(3) for _ in range(40)] for _ in range(5)]
    automaton = substrings.SuffixAutomaton()
    for p in passages:
        automaton.add(p)
    known = {tuple(p[k : k + 4]) for p in passages for k in range(37)}
    text = [rng.randrange(4) for _ in range(500)]
    states = automaton.windows(text, 4)
    assert [s >= 0 for s in states] == [k >= 3 and tuple(text[k - 3 : k + 1]) in known for k in range(500)]
    by_window = {}
    for k, s in enumerate(states):
        if s >= 0:
            assert by_window.setdefault(s, tuple(text[k - 3 : k + 1])) == tuple(text[k - 3 : k + 1])


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        v = int(c) * (1 + i % 2)
        total += v if v < 10 else v - 9
    return total % 10 == 0


def plain_spans(t):
    """The contract's patterns as they stand."""
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (338) 555-7198", "+", "é", " ", "-", ".", "0", "42", "a@b.c@d.e", "00001.2.3.4", "+12345678901234567"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("1" * 200_000 + " " + "a" * 200_000 + "@") == []


def test_pii_finds_unseen_identifiers_in_sure_contexts(spark):
    rows = [(i, f"text {i} and mail to m{i}@example.com today please") for i in range(40)]
    rows += [(100, "again mail to staff#0042 today please"), (101, "call room#0042 at noon"), (102, None), (103, ""), (103, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}
    assert got[0].n_email == 1 and got[0].spans == "email:23:41".replace("23:41", f"{rows[0][1].index('m0@')}:{rows[0][1].index(' today')}")
    assert got[100].spans == f"email:{rows[40][1].index('staff')}:{rows[40][1].index(' today')}" and got[100].n_email == 0
    assert got[101].spans == "" and got[102].base_sha256 == sha("") and pii.find(docs).count() == 45
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[100] == "again mail to [EMAIL] today please" and clean[101] == rows[41][1] and clean[102] is None
    assert pii.find(empty(spark)).count() == 0 and pii.redact(empty(spark)).count() == 0


def test_quality_on_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 90))]
        text = ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, len(words), 9)) if good else " | ".join(words[:4] * 9)
        rows.append((i, text))
        labels.append((i, int(good), 0))
    labels += [(3, None, 0), (None, 1, 0), (10_000, 0, 0)]
    rows += [(900, None), (901, ""), (900, None), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    truth = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = quality.classify(docs, truth).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 100 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > 0.97
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    kept = quality.keep_good(docs, truth)
    assert kept.columns == ["doc_id", "text"] and 350 < kept.count() < 450
    none = truth.limit(0)
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(empty(spark), truth).count() == 0


def test_statistics_do_not_depend_on_batches(texts):
    import numpy as np
    import pyarrow as pa

    from riskloom.llm.words import blocks

    column = pa.array([t for _, t in texts], pa.string())
    whole = np.concatenate([quality.statistics(b) for b in blocks(column, "space")])
    parts = np.concatenate([quality.statistics(b) for b in blocks(column, "space", block_bytes=100)])
    assert np.allclose(whole, parts) and np.isfinite(whole).all()


def test_statistics_of_a_text_alone_and_behind_others():
    import numpy as np
    import pyarrow as pa

    from riskloom.llm.words import blocks

    def measure(column):
        return np.concatenate([quality.statistics(b) for b in blocks(pa.array(column, pa.string()), "space")])

    text, other = "One two. Three four five. Six seven eight nine", "Ten. Eleven twelve!"
    junk = "no stop here " * 500
    alone = measure([text])[0]
    # gaps of two and three words, by hand
    assert np.isclose(alone[-1], np.std(np.log1p([2, 3])))
    for front in ([junk], [junk, "", None], [other], [text], [other, junk, junk]):
        assert np.array_equal(measure([*front, text, junk])[len(front)], alone)
    assert np.array_equal(measure([junk, other])[1], measure([other])[0]) and measure([junk])[0][-1] == 0


def test_first_block_of_a_worker_may_be_empty():
    up, down = words._Powers().upto(0)
    assert len(up) == len(down) == 0
    for rows in ([""], ["", " "], [None], []):
        words._POWERS = words._Powers()
        for b in words.blocks(pa.array(rows, pa.string()), "space"):
            assert len(b.hashes) == 0 and len(b) == len(rows)
            assert not b.windows(5)[1].any()


def test_words_equal_patterns(texts):
    import pyarrow as pa

    from riskloom.llm.words import blocks

    column = pa.array([t for _, t in texts] + ["É\x0bA", "\x00a\x00"], pa.string())
    for kind, lower, pattern in (("space", False, BLANK), ("space", True, BLANK), ("alnum", True, ALNUM)):
        got, names = [], Counter()
        for b in blocks(column.slice(1), kind, lower, block_bytes=999):
            for i in range(len(b)):
                got.append([b.word(j).decode() for j in range(b.bounds[i], b.bounds[i + 1])])
                names.update(zip(got[-1], b.hashes[b.bounds[i] : b.bounds[i + 1]].tolist(), strict=True))
        want = [pattern.findall((t or "").translate(LOWER) if lower else (t or "")) for t in column.slice(1).to_pylist()]
        assert got == want and len({n for n, _ in names}) == len({h for _, h in names}) == len(names)
