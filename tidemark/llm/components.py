"""Connected components of a graph given by links, with DataFrames: large-star and small-star rounds.

Every round is a pair of grouped minima (pre-aggregated before the shuffle) and joins back, which a hub node doesn't
unbalance; its edges are written to the shared folder, so lost executors cost a round at most.  The rounds end when the
edges no longer change; each task first contracts the links it holds, which leaves few rounds to do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import released, staged


def _contract(batches: Iterator[pa.RecordBatch], rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A forest with the same components as each million links or so of a task."""
    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += len(batch)
        if n >= rows:
            yield _forest(held)
            held, n = [], 0
    if held:
        yield _forest(held)


def _forest(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:  # hooking the larger root on the smaller, then jumping
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root = root[root]
    tree = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[tree]), pa.array(nodes[root[tree]])], ["u", "v"])


def connected(links: DataFrame) -> DataFrame:
    """From links (a, b) of longs: (id, component) for each id with a link; component is the smallest id it reaches."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = staged(edges.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        released(old)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return ids.unionByName(roots)
