"""Chat windows, mixtures, URL templates, archives and vectors next to brute force."""

import hashlib
import uuid
from collections import defaultdict

import numpy as np
import pytest

from riskloom.llm import chat, gridjoin, mixing, urls, warc
from riskloom.llm.common import components
from riskloom.session import shared_folder


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


CONTROL = r"</s>[INST] ok [/INST] <|user|> \\ \n <|end|>" + "\n<|>|> \\"


def test_chat_windows_read_back(spark):
    rows = [(1, 0, "system", "be " * 30), (1, 1, "user", CONTROL), (1, 2, "assistant", CONTROL * 2)]
    rows += [(1, k, "user" if k % 2 else "assistant", f"turn {k} " + "wörd " * (k * 7 % 40)) for k in range(3, 60)]
    rows += [(2, 0, "assistant", None), (2, 1, None, "no role"), (3, 5, "user", "x" * 9000), (3, 6, "assistant", "y" * 9000), (None, 1, "assistant", "no id")]
    rows += [(4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (5, 0, "we|ird|>", "a"), (6, None, "assistant", "first"), (6, 0, "user", "second")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, tokens string").repartition(3)
    windows = chat.chat_windows(turns, budget=200, history=40, block=8)
    back = chat.read_windows(windows).collect()
    told, loss = defaultdict(list), defaultdict(str)
    for w in sorted(back, key=lambda w: w.window):
        told[w.conv_id] += [(t.role, t.text) for t in w.turns]
        loss[w.conv_id] += w.loss_text
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        want[c].append((r or "", x or ""))
    assert dict(told) == dict(want)
    assert dict(loss) == {c: "".join(x for r, x in v if r == "assistant") for c, v in want.items()}
    made = sorted((w for w in windows.collect() if w.conv_id == 1), key=lambda w: w.window)
    assert len(made) > 5 and all(w.formatted.startswith("<|system|>") for w in made)
    assert all(w.n_repeated >= 1 for w in made[1:]) and any(w.n_repeated > 1 for w in made[1:])
    assert max(w.tokens for w in made) <= 200
    assert chat.chat_windows(turns.limit(0)).count() == 0


def test_chat_windows_keep_their_budget(spark):
    rng = np.random.default_rng(5)
    rows = []
    for conv in range(12):
        long = 40 if conv % 3 else 900
        sizes = [rng.integers(1, 400) if conv % 2 else 3, *rng.integers(0, long, 80), 5000, 1, *rng.integers(0, 20, 30)]
        rows += [(conv, k, "system" if k == 0 and conv % 4 else "user" if k % 2 else "assistant", f"{k}." + "x" * int(n)) for k, n in enumerate(sizes)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    for budget, history in ((120, 30), (200, 0), (64, 50)):
        made = chat.chat_windows(turns, budget, history, block=16).collect()
        size = lambda piece: max(1, -(-len(piece) // 4))
        told = defaultdict(list)
        for w in sorted(made, key=lambda w: (w.conv_id, w.window)):
            pieces = w.formatted.split("<|end|>\n")[:-1]
            assert w.tokens == sum(map(size, pieces))
            own = pieces[w.n_repeated :]
            assert w.tokens <= budget or (len(pieces) == 1 and not w.n_repeated)
            first = sum(map(size, told[w.conv_id]))
            system = [p for p in told[w.conv_id][:1] if p.startswith("<|system|>")]
            left = budget - sum(map(size, own))
            lead = [p for p in system if size(p) <= left]
            reach, past, at = min(history, left - sum(map(size, lead))), [], 0
            for n, p in enumerate(told[w.conv_id]):
                if at >= first - reach and not (n == 0 and system):
                    past.append(p)
                at += size(p)
            assert pieces[: w.n_repeated] == lead + past
            told[w.conv_id] += own
        want = defaultdict(list)
        for c, _, role, text in rows:
            want[c].append(f"<|{role}|>\n{text}")
        assert dict(told) == dict(want)
    for budget, history in ((10, 10), (10, -1)):
        with pytest.raises(ValueError):
            chat.chat_windows(turns, budget, history)


def pour(grant, kids):
    """(weight, capacity) per name, filled smallest capacity per weight first."""
    out, left, weights = {}, grant, sum(w for w, _ in kids.values())
    order = sorted(kids, key=lambda k: (kids[k][1] / kids[k][0], k))
    for n, k in enumerate(order):
        w, cap = kids[k]
        if left * w >= cap * weights:
            out[k], left, weights = min(cap, left), left - min(cap, left), weights - w
        else:
            for rest in order[n:]:
                out[rest] = min(left * kids[rest][0] // weights, kids[rest][1])
            break
    return out


def test_leaf_budgets_equal_brute_force(spark):
    rows = [("a", "en", "s1", 100), ("a", "en", "s2", 5), ("a", "de", "s1", 10), ("b", "en", "s1", 400), ("b", "fr", "s9", 0), ("c", "en", "s1", 3)]
    leaves = spark.createDataFrame(rows, "d string, l string, s string, tokens bigint")
    weights = {"d": {"a": 3}, "l": {"de": 2}, "s": {"s2": 4}}
    for total in (0, 7, 300, 900, 5000):
        want = {}
        cap = lambda p: 2 * sum(r[3] for r in rows if r[: len(p)] == p)
        w = lambda i, v: weights["dls"[i]].get(v, 1)
        tops = pour(total, {d: (w(0, d), cap((d,))) for d in {r[0] for r in rows}})
        for d, g in tops.items():
            mids = pour(g, {m: (w(1, m), cap((d, m))) for m in {r[1] for r in rows if r[0] == d}})
            for m, h in mids.items():
                ends = pour(h, {s: (w(2, s), cap((d, m, s))) for s in {r[2] for r in rows if r[:2] == (d, m)}})
                want |= {(d, m, s): x for s, x in ends.items()}
        got = {(r.d, r.l, r.s): r.grant for r in mixing.leaf_budgets(leaves, ["d", "l", "s"], total, weights, 2).collect()}
        assert got == want
        assert total > 1036 or total - sum(got.values()) < 12


def test_mix_draws_prefixes_of_seeded_epochs(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "en", "hot" if i % 3 == 0 else f"s{i % 4}", 1) for i in range(500)]
    rows += [(600, None, None, None, 1), (601, "", "en", "hot", 1), (3, "w w", "en", "hot", 1), (None, "w", "de", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, copies int").repartition(4)
    drawn = mixing.mix(docs, share=(3, 2), weights={"source": {"hot": 5}}, epochs=2).collect()
    total = sum(len((r[1] or "").split()) for r in rows)
    used = sum(r.n_tokens * r.copies for r in drawn)
    assert total * 1.5 - 100 < used <= total * 1.5 and max(r.copies for r in drawn) <= 2
    again = mixing.mix(docs.repartition(2), share=(3, 2), weights={"source": {"hot": 5}}, epochs=2).collect()
    assert sorted(map(str, drawn)) == sorted(map(str, again))
    leaf = [r for r in drawn if r.source == "s1"]
    order = lambda i, e: hashlib.md5(f"7:{e}:{i}".encode()).hexdigest()
    whole = min(r.copies for r in leaf) if len(leaf) == sum(r[3] == "s1" for r in rows) else 0
    taken = {r.doc_id for r in leaf if r.copies > whole}
    ranked = sorted((r[0] for r in rows if r[3] == "s1"), key=lambda i: order(i, whole))
    assert set(ranked[: len(taken)]) == taken
    assert mixing.mix(docs.limit(0)).count() == 0


def test_url_rules_and_templates(spark):
    cases = {
        "http://WWW.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://example.com/en/?q#z": ("example.com", "/en/", "example.com/en/", "block"),
        "https://a.example.com/en": ("a.example.com", "/en", "com/", "allow"),
        "x://notexample.com/en/2": ("notexample.com", "/en/2", "com/", "allow"),
        "http://q.net/fr/1?x=://b": ("q.net", "/fr/1", "net/fr/", "block"),
        "http://x.com?a": ("x.com", "", None, "allow"),
        "http://É.ORG/a\nb": ("É.org", "/a\nb", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    rows = [(i, u, "h") for i, u in enumerate(cases)] + [(90, None, "h"), (91, None, "h"), (None, "http://q.net/fr/1", "h")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = urls.template_tree(pages).collect()
    assert len(got) == len(rows)
    by = {r.url: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert {u: by[u] for u in cases} == cases and by[None] == ("", "", None, "allow")
    assert urls.template_tree(pages.limit(0)).count() == 0


def test_template_purity(spark):
    rules = [("block", "shop.io", "/ads/x"), ("allow", "shop.io", "/ads/y"), ("allow", "shop.io", "/doc/")]
    rows = [f"http://shop.io/ads/x{i}/p" for i in range(60)] + [f"http://shop.io/doc/t{i}" for i in range(60)]
    rows += ["http://shop.io/ads/77/p", "http://shop.io/doc2/1", "http://other.io/ads/7/p", "http://shop.io/" + "a/" * 5000]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    got = {r.page_id: r for r in urls.template_tree(pages, rules).collect()}
    assert got[120].template == "/ads/*/p" and got[120].verdict == "block" and got[120].score > 0.9
    assert got[121].verdict == got[122].verdict == got[123].verdict == "allow"
    wide = spark.createDataFrame([(i, f"http://w.io/user{chr(97 + i % 26)}{chr(97 + i // 26)}/x") for i in range(60)], "page_id bigint, url string")
    assert {r.template for r in urls.template_tree(wide).collect()} == {"/*/x"}


def test_archives_round_trip(spark):
    long = "<p>é</p>\r\n\r\nWARC/1.0\r\n" * 40
    rows = [(1, "http://a/ b\n", long), (2, None, long), (3, "http://c", None), (4, "http://c", ""), (5, "u", "short"), (6, "u", "short"), (0, "v", long[:-1]), (7, "z", "x" * 300_000), (None, "n", long), (2, "again", long)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, payload int").repartition(2)
    path = shared_folder(spark, "warc", uuid.uuid4().hex)
    got = warc.convert_pages(pages, path).collect()
    want = sorted((str(p), len((h or "").encode()), sha(h or ""), *(("revisit", 1) if h == long and p != 1 else ("response", None))) for p, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    texts = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert texts[1] == long and texts[7] == "x" * 300_000 and texts[3] == ""
    assert warc.convert_pages(pages.limit(0), shared_folder(spark, "warc", uuid.uuid4().hex)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    one = warc.arc_archive("http://a/é x", "päge", version, "20200102030405", "f.arc")
    found = list(warc.parse_arc(one + one))
    assert [f["payload"].decode() for f in found] == ["päge"] * 2
    assert found[0]["url"] == "http://a/é%20x" and found[0]["head"].startswith(b"HTTP/1.1 200")
    with pytest.raises(ValueError):
        list(warc.parse_arc(one[:-4]))


def test_grid_join_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 6))
    x = (centers[rng.integers(0, 12, 700)] + 0.25 * rng.normal(size=(700, 6))).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 6), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] + [1.0] * 5), (904, [float("inf")] + [1.0] * 5), (905, [1.0]), (906, []), (None, x[0].tolist())]
    frame = spark.createDataFrame(rows + [(*o, 1) for o in odd] + [rows[5]], "vec_id bigint, embedding array<float>, kept int").repartition(3)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    label = np.arange(700)
    while True:
        new = np.array([label[near[i]].min() for i in range(700)])
        if (new == label).all():
            break
        label = new
    want = {i: (int(near[i].sum()) - 1, int(label[i]), bool(label[i] == i)) for i in range(700)}
    want |= {o[0]: (0, o[0], True) for o in odd}
    for block in (2048, 64):
        got = gridjoin.near_duplicates(frame, block=block).collect()
        assert len(got) == 709 and {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want
    assert gridjoin.near_duplicates(frame.limit(0)).count() == 0
    assert gridjoin.near_duplicates(frame.where("vec_id between 900 and 904")).count() == 5


def test_grid_join_of_several_lengths(spark):
    rng = np.random.default_rng(6)
    rows = []
    for d, n in ((6, 150), (9, 120), (2, 40), (1, 3)):
        centers = rng.normal(size=(8, d))
        x = (centers[rng.integers(0, 8, n)] + 0.2 * rng.normal(size=(n, d))).astype(np.float32)
        x[5 : n // 4] = x[0]
        rows += [v.tolist() for v in x]
    ids = rng.permutation(len(rows)).tolist()
    frame = spark.createDataFrame(list(zip(ids, rows, strict=True)), "vec_id bigint, embedding array<float>").repartition(3)
    units = {i: np.array(v) / np.linalg.norm(v) for i, v in zip(ids, rows, strict=True)}
    near = {i: [j for j in units if len(units[j]) == len(units[i]) and units[i] @ units[j] >= 0.9] for i in units}
    low = {i: i for i in units}
    while True:
        new = {i: min(low[j] for j in near[i]) for i in units}
        if new == low:
            break
        low = new
    want = {i: (len(near[i]) - 1, low[i], low[i] == i) for i in units}
    # the second commonest length has links of its own
    assert sum(want[i][0] > 0 for i in units if len(units[i]) == 9) > 100
    for block in (2048, 32):
        got = gridjoin.near_duplicates(frame, block=block).collect()
        assert len(got) == len(rows) and {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want
    # one id with vectors of two lengths is one node; each row counts the links of its own vector
    two = [(1, [1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.1, 0.0]), (4, [1.0, 0.0, 0.1])]
    got = gridjoin.near_duplicates(spark.createDataFrame(two, "vec_id bigint, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_grid_join_of_ids_with_several_vectors(spark):
    # id 1 and id 5 hold two vectors each; links are counted by vector, components unite all vectors of an id
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.0, 1.0, 0.1]), (4, [0.1, 1.0, 0.0])]
    rows += [(5, [1.0, 0.0, 0.0]), (5, [0.0, 0.0, 1.0]), (6, [0.0, 0.0, 2.0]), (6, [0.0, 0.0, 2.0]), (7, [1.0, 1.0, 1.0]), (None, [1.0, 0.0, 0.0])]
    got = gridjoin.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)).collect()
    want = [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 1), (5, 1, 1), (5, 2, 1), (6, 1, 1), (6, 1, 1), (7, 0, 7), (None, 0, None)]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(want, key=str)
    hot = [(8, [float(k == j) for j in range(40)]) for k in range(40)] + [(9, [0.0] * 39 + [1.0])]
    got = gridjoin.near_duplicates(spark.createDataFrame(hot, "vec_id bigint, embedding array<double>")).collect()
    assert {(r.vec_id, r.component_id, r.kept) for r in got} == {(8, 8, True), (9, 8, False)} and sum(r.n_links for r in got) == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 120, 2)] + [(i + 1, i + 2) for i in range(0, 60, 2)] + [(500, 500), (9, 8), (9, 8), (700, 3)]
    up = {}

    def root(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: root(v) for v in up if v != 500}
