import random

import pytest
from brute import components, shingle_components

from tidemark.llm.components import connected
from tidemark.llm.jaccard import Scheme, one_of_each, similar_classes


def texts(seed, n=150):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "x\x00"]
    license_ = " ".join(rnd.choice(vocab) for _ in range(60))
    bases = [[rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 5, 12, 25, 40, 90, 200]))] for _ in range(12)]
    rows = []
    for d in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 4, 8])):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.randint(0, 1)] = [rnd.choice(vocab)]
        t = " ".join(w)
        if rnd.random() < 0.2:
            t += "\n" + license_
        rows.append((d * 5, t.upper() if rnd.random() < 0.3 else t))
    return rows + [(10_000, None), (10_001, ""), (10_002, " \t")]


@pytest.mark.parametrize(("seed", "k", "num", "den"), [(1, 3, 90, 100), (2, 5, 80, 100)])
def test_matches_brute_force(spark, seed, k, num, den):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, similar_classes(df, k, num, den).collect()))
    assert got == shingle_components(rows, k, num, den)


def test_scheme_shares_a_class_and_a_bucket():
    for num in (60, 80, 90):
        s = Scheme(num, 100)
        for n in range(1, 900):
            for other in (n, -(-n * num // 100)):
                level, m, spare = s.classes(min(n, other))[0]
                assert (level, m, spare) in s.classes(max(n, other))
                assert m > s.differences(n, other) + spare


def test_one_of_each_keeps_columns(spark):
    df = spark.createDataFrame([(2, "a b c d", 1), (1, "A b c d", 2), (None, "a b c d", 3), (3, None, 4)], "doc_id long, text string, key int")
    out = one_of_each(df, k=3, num=90)
    assert out.columns == df.columns
    assert sorted(r["key"] for r in out.collect()) == [2, 3, 4]
    assert similar_classes(df.limit(0)).collect() == []


def test_components_of_chains_and_hubs(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(80)]
    got = dict(map(tuple, connected(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()))
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == components(ids, [(a, b) for a, b in links if a != b])


def test_shared_ids_keep_the_links_of_all_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = lambda t: t.replace("30", "x")
    rows = [(5, a), (5, b), (1, near(a) + " z"), (2, near(b) + " z"), (9, "alone"), (None, a), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as component", "2 as key", "3 as n", "4 as g")
    out = sorted((tuple(r) for r in similar_classes(df, 3, 80, 100).collect()), key=str)
    assert out == sorted([(5, 58, 1), (5, 58, 1), (1, 59, 1), (2, 59, 1), (9, 1, 9), (None, 58, None), (None, 0, None)], key=str)
    kept = one_of_each(df, k=3, num=80, den=100)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"][:2] if r["text"] else None) for r in kept.collect()), key=str) == sorted([(1, "a0"), (2, "b0"), (9, "al"), (None, "a0"), (None, None)], key=str)


def test_a_megabyte_of_text(spark):
    text = " ".join(str(i * 7919 % 100_003) for i in range(150_000))
    out = {r["doc_id"]: r["component_id"] for r in similar_classes(spark.createDataFrame([(4, text), (6, text + " more"), (8, "other words here")], "doc_id long, text string"), 3, 90, 100).collect()}
    assert out == {4: 4, 6: 4, 8: 8}
