import re
import zlib

import numpy as np

from tidemark.llm import language
from tidemark.llm.language import identified, learn, mixture, predict


def test_held_out_accuracy_and_undetermined(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    told = [r for r in out if r["held_out"]]
    assert len(out) == docs.count() and len(told) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in told]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (3, "der hund und die katze", "de"), (5, None, "en"), (6, "123 !?", None), (7, "", "de"), (7, "", "de"), (None, "the dog", "en"), (9, "x" * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as held_out", "2 as score")
    out = identified(df).collect()
    assert len(out) == 8
    assert {r["lang_pred"] for r in out if r["doc_id"] in (5, 6, 7)} == {"und"}
    assert {r["lang_pred"] for r in identified(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
    assert identified(df.limit(0)).collect() == []


def test_mixed_texts_get_several_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = learn(docs)
    texts = {r["lang"]: r["text"] for r in docs.filter("n_chars > 3000").select("lang", "text").collect()}
    a, b = sorted(texts)[:2]
    out = predict(spark.createDataFrame([(1, texts[a][:2000] + " " + texts[b][:1000])], "doc_id long, text string"), model).first()
    assert set(out["languages"]) == {a, b} and out["lang_pred"] == a and 0.5 < out["score"] < 0.85


def test_mixture_is_the_penalised_maximum():
    rng = np.random.default_rng(1)
    ll = np.log(rng.random((40, 3)) + 0.01)
    assert mixture(ll, np.array([0, 40]), 1e9).max() == 1  # no penalty is worth a second language
    pi = mixture(ll, np.array([0, 0, 40]), 0.0)
    assert pi[0].sum() == 0 and abs(pi[1].sum() - 1) < 1e-9


def test_a_text_does_not_depend_on_its_neighbours():
    # three languages pay here, the two with the largest shares alone don't
    ll = np.full((80, 4), -12.0)
    ll[:, 2] = -3
    ll[:30, 0], ll[30:60, 1], ll[60:, 2] = 0, 0, 0
    pair = np.full((60, 4), -12.0)
    pair[:30, 0], pair[30:, 1] = 0, 0
    alone = mixture(ll, np.array([0, 80]))[0]
    assert np.allclose(alone, mixture(np.concatenate([ll, pair]), np.array([0, 80, 140]))[0])
    assert (alone > 0).sum() == 3


def test_counts_of_many_labels_equal_plain_python(spark):
    import random
    from collections import Counter, defaultdict

    rnd = random.Random(1)
    rows = [(i, " ".join("".join(rnd.choice("abcéxyz") for _ in range(rnd.randint(1, 6))) for _ in range(8)) + " 12!", f"l{i % 150}" if i % 5 else "en") for i in range(400)] + [(9000, None, "en"), (9001, "", "zz"), (9002, "abc", None)]
    names, table = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    want = defaultdict(Counter)
    for i, t, lang in rows:
        if lang is None or t is None or zlib.crc32(str(i).encode()) % 4 == 2:
            continue
        want[lang]
        for w in re.findall(rb"[A-Za-z\x80-\xff]+", t.lower().encode()):
            b = b" " + w + b" "
            for k in range(1, len(b) - 1):
                want[lang][((b[k - 1] << 16 | b[k] << 8 | b[k + 1]) * 2654435761 & 0xFFFFFFFF) >> 16] += 1
    assert names == sorted(want)
    for name, row in zip(names, table, strict=True):
        c = np.array([want[name][k] for k in range(1 << 16)]) + 0.5
        assert np.abs(row - np.log(c / c.sum())).max() < 1e-4


def test_proportions_are_a_fixed_point_and_hang_on_the_text_alone():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 60, 40)
    first = np.concatenate([[0], np.cumsum(size)])
    ll = rng.normal(-20, 6, (first[-1], 5)).astype(np.float32)
    out = language.mixture(ll, first)
    for d in range(40):
        part = ll[first[d] : first[d + 1]]
        alone = language.mixture(part, np.array([0, len(part)]))[0]
        assert np.abs(alone - out[d]).max() < 1e-6
        like = np.exp((part - part.max(axis=1, keepdims=True)).astype(float)) * out[d]
        again = (like / like.sum(axis=1, keepdims=True)).mean(axis=0)
        assert abs(out[d].sum() - 1) < 1e-9 and np.abs(again - out[d]).max() < 2 * language.TOLERANCE
