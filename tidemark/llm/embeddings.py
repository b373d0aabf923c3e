"""Embedding near-dedup by spherical-cap filters from a structured random product code.

Dimensions are rotated at random and dealt into blocks; each block has a random code.  A filter direction is one code word
of each block, so a few hundred words give a filter for every handful of vectors.  A vector is list-decoded to its best
filters, those with the greatest inner products: blocks are searched in turn, dropping what can't be among the best.
Every vector has as many filters, so exact copies always meet.  Vectors of one label meet in their common filters, a
pair is judged in the smallest of them alone, by its cosine in double precision, and links are counted and joined to
components.

The number of filters grows with the number of vectors, so that a filter's expected load stays the same.  How many a
vector takes is measured for each vector length and number of vectors: the fewest with which random pairs just at the
least cosine meet as often as RECALL asks (the rotation is random, so any pair is like a random one).  Vectors of a
length that few have (at most a tile) are all compared.  Filters with
more than a tile of vectors are dealt into pairs of tiles, each a task of its own, so no group of near copies meets in
one place; within a tile the cosines are one matrix product.

Rules for odd input: vectors that are null, zero, or hold null or non-finite components link with nothing, nor do rows
whose label is null; vectors of different lengths don't link; rows without an id link with nothing, have no component
and are not kept; rows that share an id are different vectors of one node: links among them don't count for themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.components import connected
from tidemark.llm.textcore import U64, seeded

#: Vectors in one tile of a crowded filter.
TILE = 512
#: Filters that a vector falls into at least, and vectors of all labels that fall into a filter on average.
FILTERS_EACH, LOAD = 16, 32
#: Share of the pairs at the least cosine that must meet, the random pairs it is measured on, and the most filters tried.
RECALL, PAIRS, MOST_EACH = 0.995, 1000, 512


class ProductCode:
    """Filter directions: a code word for each block; a vector falls into the best `each` of them."""

    def __init__(self, dim: int, vectors: int, each: int = FILTERS_EACH, load: float = LOAD, seed: int = 7):
        rng = np.random.default_rng([seed, dim])
        wanted = max(64.0, vectors * each / load, each * 8)
        most = 1 if wanted <= 256 else 2 if wanted <= 1 << 20 else 3 if wanted <= 1 << 30 else 4
        self.each = each
        self.blocks = max(1, min(dim // 4, most))
        self.words = min(math.ceil(wanted ** (1 / self.blocks)), 1 << 12)  # short vectors can't have more blocks: fuller filters
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            c = rng.standard_normal((self.words, b - a))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(self.blocks))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, filters) for unit vectors x: the `each` filters of each with the greatest inner products."""
        y = x @ self.turn
        have, name = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        k = min(self.each, self.words)
        for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.codes, strict=True):
            score = y[:, a:b] @ c.T
            word = np.argpartition(-score, k - 1, axis=1)[:, :k]
            word = np.take_along_axis(word, np.argsort(-np.take_along_axis(score, word, axis=1), axis=1, kind="stable"), axis=1)
            # the i-th best so far with the j-th best word: i * j - 1 others are as good
            i, j = np.nonzero(np.outer(np.arange(1, have.shape[1] + 1), np.arange(1, k + 1)) <= self.each)
            total = have[:, i] + np.take_along_axis(score, word, axis=1)[:, j]
            best = np.argsort(-total, axis=1, kind="stable")[:, : self.each]
            have = np.take_along_axis(total, best, axis=1)
            name = np.take_along_axis(name[:, i] * self.words + word[:, j], best, axis=1)
        return np.repeat(np.arange(len(x)), name.shape[1]), name.ravel()


def recall(code: ProductCode, dim: int, cosine: float, pairs: int = PAIRS, seed: int = 11) -> float:
    """Share of random pairs at a cosine that have a filter in common."""
    rng = np.random.default_rng([seed, dim])
    x, z = rng.standard_normal((2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * z
    met = 0
    for lo in range(0, pairs, 250):
        a, b = (np.sort(code.decode(v[lo : lo + 250])[1].reshape(len(v[lo : lo + 250]), -1), axis=1) for v in (x, y))
        met += int((a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).sum())
    return met / pairs


def filters_each(dim: int, vectors: int, cosine: float, least: int = FILTERS_EACH) -> int:
    """The fewest filters a vector, from `least` on, with which RECALL of the pairs at a cosine meet."""
    each = least
    while each < MOST_EACH and recall(ProductCode(dim, vectors, each), dim, cosine) < RECALL:
        each = min(MOST_EACH, math.ceil(each * 1.5))
    return each


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoded(lengths: dict[int, tuple[int, int]], kind: str):
    """lengths: for each vector length how many vectors have it and into how many filters each falls."""
    codes: dict[int, ProductCode] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            by_dim: dict[int, list[int]] = {}
            rows = batch.column("v").to_pylist()
            for i, v in enumerate(rows):
                by_dim.setdefault(len(v), []).append(i)
            for dim, at in by_dim.items():
                alone = lengths[dim][0] <= TILE
                if not alone and dim not in codes:
                    codes[dim] = ProductCode(dim, *lengths[dim])
                for some in np.array_split(np.array(at), max(1, len(at) // 512)):
                    x = np.array([rows[i] for i in some], kind)
                    row, name = (np.arange(len(x)), np.zeros(len(x), np.int64)) if alone else codes[dim].decode(_unit(x))
                    base = seeded(labels[some].astype(np.int64).view(U64) + U64(dim) * U64(0x9E3779B97F4A7C15), 3)
                    key = seeded(name.view(U64) ^ base[row], 4).view(np.int64)
                    cut = np.searchsorted(row, np.arange(len(some) + 1))
                    lists = [np.sort(key[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    raw = [r.tobytes() for r in x]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(ids[some][row]), pa.array(labels[some][row].astype(np.int64)), pa.array([lists[r] for r in row], pa.binary()), pa.array([raw[r] for r in row], pa.binary())],
                        ["key", "vec_id", "label", "filters", "v"],
                    )

    return run


def _tile_links(least: float, kind: str):
    def run(table: pa.Table) -> pa.Table:
        key, i, j, own = (table.column(c).to_numpy() for c in ("key", "i", "j", "own"))
        ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        filters, raw = table.column("filters").to_pylist(), table.column("v").to_pylist()
        order = np.lexsort((ids, own, j, i, key))
        edge = np.ones(len(order) + 1, bool)
        for c in (key, i, j):
            edge[1:-1] &= c[order][1:] == c[order][:-1]
        cuts = np.flatnonzero(np.concatenate([[True], ~edge[1:-1], [True]])) if len(order) else np.zeros(1, int)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[a:b]
            if b - a < 2:
                continue
            left, right = at[own[at] == i[at[0]]], at[own[at] == j[at[0]]]
            if not len(left) or not len(right) or len({len(raw[x]) for x in at}) > 1:
                continue
            x, y = (_unit(np.frombuffer(b"".join(raw[k] for k in s), kind).reshape(len(s), -1)) for s in (left, right))
            r, c = np.nonzero(x @ y.T >= least - 1e-9)
            if i[at[0]] == j[at[0]]:
                r, c = r[r < c], c[r < c]
            u, v = left[r], right[c]
            ok = (labels[u] == labels[v]) & (ids[u] != ids[v])
            u, v = u[ok], v[ok]
            cos = np.einsum("ij,ij->i", x[r[ok]], y[c[ok]])
            u, v = u[cos >= least], v[cos >= least]
            mine = key[at[0]]
            sets = {k: np.frombuffer(filters[k], np.int64) for k in set(u.tolist()) | set(v.tolist())}
            first = np.array([_first_common(sets[p], sets[q]) == mine for p, q in zip(u.tolist(), v.tolist(), strict=True)], bool)
            us.append(ids[u[first]])
            vs.append(ids[v[first]])
        u, v = np.concatenate(us), np.concatenate(vs)
        node, count = np.unique(np.concatenate([u, v]), return_counts=True)
        tree = _forest(u, v)
        return pa.table({"kind": np.concatenate([np.zeros(len(node), np.int32), np.ones(len(tree[0]), np.int32)]), "a": np.concatenate([node, tree[0]]), "b": np.concatenate([count, tree[1]]).astype(np.int64)})

    return run


def _first_common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    hit = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a)
    return int(a[hit[0]])


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what (u, v) connect, at most one a node."""
    from tidemark.llm.components import _forest as forest

    if not len(u):
        return u, v
    out = forest([(u, v)])
    return out.column(0).to_numpy(), out.column(1).to_numpy()


def near_links(vectors: DataFrame, least: float = 0.98, each: int = FILTERS_EACH, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept (it is the smallest of its component)."""
    # single precision is carried as it is; cosines are computed in double precision from the given components
    kind = "float" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "double"
    dtype = "<f4" if kind == "float" else "<f8"
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"), F.xxhash64(F.col(label_col).cast("string")).alias("label"), F.col(label_col).isNotNull().alias("ok"))
    nameless, base = base.filter("vec_id is null"), base.filter("vec_id is not null")
    usable = base.filter("ok and size(v) > 0").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).drop("ok")
    # one row for each vector length
    sizes = {r["dim"]: r["count"] for r in usable.groupBy(F.size("v").alias("dim")).count().collect()}
    lengths = {dim: (n, filters_each(dim, n, least, each) if n > TILE else 1) for dim, n in sizes.items()}
    n_entries = sum(n * f for n, f in lengths.values())
    # decoded twice rather than stored: an entry is far larger than the key that the first pass counts
    entries = usable.mapInArrow(_decoded(lengths, dtype), "key long, vec_id long, label long, filters binary, v binary")
    crowded = entries.groupBy("key").count().filter(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).cast("long").alias("tiles"))
    placed = entries.join(staged(crowded, "cap-crowded"), "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("vec_id", F.lit(1)), "tiles")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    placed = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vec_id", "label", "filters", "v")
    buckets = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_entries / 20_000))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("key", "i", "j"), F.lit(buckets)))
    found = staged(placed.groupBy("bucket").applyInArrow(_tile_links(least, dtype), "kind int, a long, b long"), "cap-links")
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("c_id")).agg(F.sum("b").alias("n"))
    parts = connected(found.filter("kind = 1").select("a", "b"))
    base = base.unionByName(nameless)
    out = base.select("vec_id").join(counts, F.col("vec_id") == F.col("c_id"), "left").join(parts, F.col("vec_id") == F.col("id"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
