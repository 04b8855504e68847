import hashlib

import corpus_pipeline
from tessera.llm import common, mixing, pii, quality
from test_documents import plain_near_copies, plain_spans


def staged(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.keep(stage(spark, out[-1], sf), name.split()[0]))
    return out


def test_stages(spark, sf):
    docs, good, single, clean, mixed, encoded = staged(spark, sf)
    assert good.columns == single.columns == clean.columns == mixed.columns == docs.columns
    whole = {r["doc_id"]: r for r in docs.collect()}
    judged = {r["doc_id"]: r["kept"] for r in quality.quality(docs).select("doc_id", "`__quality`.kept").collect()}
    rows = good.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, k in judged.items() if k) and all(whole[r["doc_id"]] == r for r in rows)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(plain_near_copies({r["doc_id"]: r["text"] for r in rows}).values()))
    field = pii.default_field()
    for r in clean.collect():
        before = whole[r["doc_id"]]["text"]
        ((_, spans),) = pii.every_span([before], field)
        assert r["text"] == pii.masked(before, spans) and not plain_spans(r["text"]) and r["n_chars"] == len(r["text"])
    reads = {r["doc_id"]: len(r["__mix_positions"]) for r in mixing.plan(clean).collect()}
    order = [r["doc_id"] for r in mixed.collect()]
    assert {i: order.count(i) for i in set(order)} == {i: n for i, n in reads.items() if n}
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    final = encoded.collect()
    assert sorted(r["doc_id"] for r in final) == sorted(order)
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in final)


def test_stages_on_awkward_rows(spark, awkward, empty, sf):
    for first in (awkward, empty):
        docs = first
        for name, stage in corpus_pipeline.STAGES:
            docs = common.keep(stage(spark, docs, sf), name.split()[0])
            assert docs.count() >= 0
        for name, stage in corpus_pipeline.STAGES:  # each by itself
            out = stage(spark, first, sf)
            assert out.columns == first.columns or name.startswith("Sentence")
            out.count()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
