import math

import numpy as np
import pytest
from brute import components

from tidemark.llm.embeddings import ProductCode, filters_each, near_links, recall

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    links = []
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    by = {}
    for i, v, lab in good:
        by.setdefault((lab, len(v)), []).append((i, v / np.linalg.norm(v)))
    for group in by.values():
        x = np.array([v for _, v in group])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            links.append((group[a][0], group[b][0]))
    ids = {i for i, _, _ in rows if i is not None}
    c = components(ids, links)
    n = {i: 0 for i in ids}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], c[i], c[i] == i) for i in ids}, links


@pytest.mark.parametrize("crowd", [30, 1200])
def test_recall_and_no_false_links(spark, crowd):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 64))
    rows = []
    for i in range(1500):
        v = centres[i % 40] + rng.standard_normal(64) * rng.choice([0.05, 0.14, 1.0])
        rows.append((i * 2, [float(np.float32(x)) for x in v], int(i % 3)))
    v = rng.standard_normal(64)
    rows += [(10_000 + i, [float(np.float32(x)) for x in v + rng.standard_normal(64) * 0.01], 1) for i in range(crowd)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want, links = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_links(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.95 * 2 * len(links)
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.97


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as v", "3 as bucket")
    out = {r["vec_id"]: tuple(r)[1:] for r in near_links(df).collect()}
    assert out[2][1:] == (1, False) and out[1][1:] == (1, True)
    assert all(out[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert near_links(df.limit(0)).collect() == []


@pytest.mark.parametrize("vectors", [20_000, 200_000, 1_100_000, 30_000_000])
def test_recall_holds_as_the_table_grows(vectors):
    code = ProductCode(64, vectors, filters_each(64, vectors, 0.98))
    assert recall(code, 64, 0.98, pairs=2000, seed=5) >= 0.99
    x = np.random.default_rng(6).standard_normal((500, 64))
    row, _ = code.decode(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert (np.bincount(row, minlength=500) > 0).all()
