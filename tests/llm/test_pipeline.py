"""The pipeline's stages one by one on the smallest tables, each against what its input says it should do."""

import re

import corpus_pipeline
from riskloom.llm import decontaminate, pii
from riskloom.llm.queries import QUERIES, SQL, table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents").cache()
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER).cache()
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before), name
        if n < 4:
            assert out.columns == docs.columns
        if n == 0:
            assert sum((i in after) != bool(q) for i, q in labels.items() if i in before) <= 0.03 * len(labels)
        if n == 1:
            assert {after[i].text for i in after} == {before[i].text for i in before} - {before[i].text for i in set(before) - set(after)} | {after[i].text for i in after}
            assert len({r.text for r in after.values()}) == len(after)
        if n == 2:
            hit = decontaminate.digest(decontaminate.scan(docs, table(spark, FOLDER, "benchmark"))).where("contaminated")
            assert set(before) - set(after) == {r.doc_id for r in hit.collect()}
        if n == 3:
            assert set(after) == set(before)
            assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in after.values())
            plain = re.compile(r"\[(EMAIL|IP|CARD|PHONE)\]")
            assert all(plain.search(after[i].text) or after[i].text == before[i].text for i in after)
        if n == 4:
            assert all(1 <= r.copies <= 3 for r in after.values())
        docs = out
    assert sorted(map(str, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(str, docs.collect()))


def test_every_operator_has_its_query():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES} == set(range(1, 14))
    assert set(SQL) <= set(QUERIES)
