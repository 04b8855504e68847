import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import kneser_ney, queries

SCHEMA = "doc_id long, text string, score string, __id int"


def words(text):
    out = (text or "").encode().lower().split()
    return [*out, "END"]


def brute(train, order):
    """log10 p of a text, by the formula, with dictionaries."""
    grams = {n: Counter() for n in range(1, order + 1)}
    raw = Counter()
    for t in train:
        w = ["BEGIN"] * (order - 1) + words(t)
        raw.update(words(t))
        for i in range(order - 1, len(w)):
            grams[order][tuple(w[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        for g in grams[n + 1]:
            grams[n][g[1:]] += 1
    vocabulary, discount, totals, after = len(raw), {}, {}, {}
    for n in grams:
        c = Counter(grams[n].values())
        discount[n] = kneser_ney.discounts([c[k] for k in (1, 2, 3, 4)])
        totals[n], after[n] = Counter(), defaultdict(Counter)
        for g, x in grams[n].items():
            totals[n][g[:-1]] += x
            after[n][g[:-1]][min(x, 3)] += 1

    def p(context, w, n):
        if n == 0:
            return 1 / (vocabulary + 1)
        below = p(context[1:], w, n - 1)
        if not totals[n][context]:
            return below
        c, d = grams[n][(*context, w)], discount[n]
        return max(c - d[min(c, 3)], 0) / totals[n][context] + sum(d[k] * m for k, m in after[n][context].items()) / totals[n][context] * below

    def score(text):
        w = ["BEGIN"] * (order - 1) + words(text)
        return sum(math.log10(p(tuple(w[i - order + 1 : i]), w[i], order)) for i in range(order - 1, len(w)))

    return raw, p, score


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_the_formula(spark, order):
    texts = ["The cat sat on the mat", "the cat  ran\ton THE hill", "a dog sat on a mat a dog sat", None, "", "the cat sat", "é à É the", "the cat sat on the hill"] * 2 + ["unseen words only", " \n "]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    model = kneser_ney.train(docs.where("doc_id < 14"), order=order)
    raw, p, score = brute(texts[:14], order)
    got = {r["doc_id"]: r for r in kneser_ney.scored(docs, model).collect()}
    assert len(got) == len(texts)
    n, v = sum(raw.values()), len(raw)
    for i, t in enumerate(texts):
        assert got[i]["score"] == pytest.approx(score(t), abs=1e-9)
        assert got[i]["n_tokens"] == len(words(t)) and got[i]["n_known"] == sum(w in raw for w in words(t))
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((raw[w] + 1) / (n + v + 1)) for w in words(t)), abs=1e-9)
        assert got[i]["train_tokens"] == n
    for context in (("BEGIN",) * (order - 1), ("on", "the")[-(order - 1) :], (b"on", b"the")[-(order - 1) :]):
        assert sum(p(context, w, order) for w in [*raw, "never"]) == pytest.approx(1)


def test_nothing_to_train_on(spark):
    docs = spark.createDataFrame([(1, "a b", "", 0)], SCHEMA)
    model = kneser_ney.train(docs.where("false"))
    (row,) = kneser_ney.scored(docs, model).collect()
    assert (row["score"], row["base_score"], row["n_known"], row["train_tokens"]) == (0, 0, 0, 0)
    assert kneser_ney.scored(docs.where("false"), model).collect() == []


def test_query_on_its_table(spark, sf):
    rows = queries.op2_lm_scoring(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    raw, _, score = brute([t for i, t in docs.items() if not held(i)], 3)
    assert {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == sum(raw.values())
        assert r["score"] == pytest.approx(score(docs[r["doc_id"]]), rel=1e-9)
    away = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in away) > sum(r["base_score"] for r in away)


def test_large_counts_are_packed_whole():
    columns = [np.sort(np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)) for _ in range(2)]
    counts = np.array([1, 254, 255, 256, 2**40] * 10)
    blobs = list(kneser_ney.pack(columns, counts, 1, 2))
    back, n = kneser_ney.unpack([b[2] for b in blobs] * 2, 2)
    assert (n == np.tile(counts, 2)).all() and all((x == np.tile(y, 2)).all() for x, y in zip(back, columns))
    assert kneser_ney.narrow(counts).dtype == np.uint64 and (kneser_ney.narrow(counts) == counts).all()


def test_grams_take_few_bytes(spark, tmp_path):
    r = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in np.minimum(r.zipf(1.3, 400), 9000)) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA).repartition(2)
    kneser_ney.train(docs, path=str(tmp_path))
    grams = {g for t in texts for w in [["", "", *words(t)]] for g in zip(w, w[1:], w[2:])}
    assert sum(f.stat().st_size for f in tmp_path.iterdir()) < 64 * 3 * 1200 + 20 * len(grams)  # parts have heads
    a = np.sort(r.integers(0, 1 << 20, 50_000).astype(np.uint64))
    columns = [a, *r.integers(0, 1 << 20, (2, 50_000)).astype(np.uint64)]
    ((_, _, blob),) = kneser_ney.pack(columns, np.ones(50_000, dtype=np.int64), 1, 3)
    assert len(blob) < 8 * 50_000
    back, n = kneser_ney.unpack([blob], 3)
    assert all((x == y).all() for x, y in zip(back, columns)) and n.sum() == 50_000
