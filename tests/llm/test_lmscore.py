import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import brute_lm
from brute import SPACED, lower

from tidemark.llm.lmscore import bits_per_byte, scored


def brute(docs):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    toks = [(d, [*SPACED.findall(lower(t or "")), None]) for d, t in docs]
    c = Counter(x for d, w in toks if not held[d] for x in w)
    n, v = sum(c.values()), len(c)
    return sorted((d, held[d], len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for d, w in toks)


@pytest.mark.parametrize("head", [1 << 17, 50])
def test_base_matches_brute_force_and_model_beats_it(spark, head):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(10_000, None), (10_001, ""), (10_002, "zzz " * 3000 + "qqq" * 500), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = scored(df, head=head).collect()
    assert sorted((*tuple(r)[:5], round(r["base_score"], 6)) for r in out) == brute(rows)
    held = [r for r in out if r["held_out"] and r["n_tokens"] > 20]
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    bytes_of = {d: len(t.encode()) for d, t in rows if t}
    assert np.mean([-r["score"] / math.log10(2) / bytes_of[r["doc_id"]] for r in held]) < (3.5 if head > 50 else 4.5)
    if head > 50:
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (None, "x")], "doc_id long, text string")
    out = scored(df).collect()
    assert sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"]) for r in out) == [(0, None, 2, 0), (1, True, 3, 0)]
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert scored(df.limit(0)).collect() == []
    assert bits_per_byte(scored(df), df).first()["bits_per_byte"] > 0


@pytest.mark.parametrize("head", [1 << 17, 12])
def test_scores_equal_plain_python(spark, head):
    rnd = random.Random(4)
    words = [f"{a}{b}" for a in ("the", "of", "in", "gra", "tion", "é") for b in ("", "s", "ing", "𝄞", "ed")]
    passage = [rnd.choice(words) for _ in range(60)]
    docs = [(i, " ".join([rnd.choice(words[: 1 + rnd.randint(0, 29)]) if rnd.random() < 0.95 else f"new{rnd.randint(0, 99)}" for _ in range(rnd.choice([3, 20, 70]))] + (passage if i % 4 == 0 else []))) for i in range(26)]
    docs += [(100, " ".join(rnd.choice(words) for _ in range(1300))), (101, None), (102, "A\tthe\nOF the"), (5, "shared the of in"), (None, "no id of the")]
    got = scored(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), head=head).collect()
    want = sorted(zip([str(d) for d, _ in docs], brute_lm.scores(docs, head), strict=True))
    assert [str(r["doc_id"]) for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["score"]))] == [d for d, _ in want]
    for r, (_, w) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["score"])), want, strict=True):
        assert abs(r["score"] - w) < 2e-3 * max(1, abs(w)), (r, w)


def test_a_text_that_occurs_twice_scores_far_better(spark):
    rnd = random.Random(6)
    texts = [" ".join(f"w{rnd.randint(0, 400)}" for _ in range(80)) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:5])]
    out = {r["doc_id"]: r["score"] for r in scored(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    taught = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    twice = [out[i] for i in range(5) if taught(1000 + i)] + [out[1000 + i] for i in range(5) if taught(i)]
    assert twice and min(twice) > 0.5 * max(out[i] for i in range(5, 60))


def test_hot_contexts_are_split_by_bucket_and_stay_whole():
    import pyarrow as pa

    from tidemark.llm import lmscore as L

    texts = [f"of the w{i} x" for i in range(300)] + ["of the w7 x"] * 3
    table = pa.table({"doc_id": pa.array(range(303), pa.int64()), "text": texts, "h": pa.array(range(303), pa.int64()), "learn": [True] * 303, "bucket": [0] * 303})
    codes = L.Codes(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)
    asked = {b: L.Asked(codes, table, b, 1000) for b in (0, 1, 8)}
    assert np.array_equal(asked[0].entry, asked[8].entry) and 295 < len(np.setdiff1d(asked[0].entry, asked[1].entry)) <= 300  # followers are told apart by 16 bits
    assert all(a.count.sum() == 303 * 5 and len(a.entry) == len(asked[0].entry) for a in asked.values())
    rows = list(asked[0].rows(0))
    assert sum(len(L.unpack(p)[4]) for _, kind, p in rows if kind == 0) == len(asked[0].entry)


def test_a_megabyte_of_text(spark):
    docs = [(1, "a b c d " * 125_000), (2, "z" * 1_000_000), (3, "q r " * 10)]
    out = {r["doc_id"]: r for r in scored(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[1]["n_tokens"] == 500_001 and out[2]["n_tokens"] == 2 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in out.values())


def test_guesses_do_not_hang_on_the_number_of_buckets():
    from types import SimpleNamespace

    import pyarrow as pa

    from tidemark.llm import lmscore as L

    codes = SimpleNamespace(value=L.Codes(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1))

    def keys(bucket, n_buckets):
        texts = [f"of the w{i} x" for i in range(300)]
        table = pa.table({"doc_id": pa.array(range(300), pa.int64()), "text": texts, "h": pa.array(range(300), pa.int64()), "learn": [True] * 300, "bucket": [bucket] * 300})
        out = L._ask(codes, n_buckets)(table).to_pydict()
        sent = [L.unpack(p) for kind, p in zip(out["kind"], out["payload"], strict=True) if kind == 0]
        return sorted(int(k) for _, lead, low, high, _, _ in sent for k in np.concatenate([lead, lead + np.cumsum(high.astype(np.uint64) << np.uint64(16) | low.astype(np.uint64))]))

    assert keys(0, 1000) == keys(1, 1000)  # all texts ask the same place about "of the"
    assert max(Counter(keys(0, 1000)).values()) > 295
