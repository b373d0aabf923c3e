"""Graph operators on edge tables (src, dst, weight): degrees, dangling nodes, PageRank, components and score features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.joins import lookups
from tidemark.sources.tables import collected, staged, unstaged


def edge_weights(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()  # one pass over the edges


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") == F.col("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return edges.select(F.inline(ends)).groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def degree_report(edges: DataFrame, k: int = 10, fraction: float = 0.01, seed: int = 7) -> tuple[list, float, DataFrame]:
    """(the k nodes of greatest out-degree, the mean out-degree over all nodes, a sample of nodes with theirs)."""
    d = degrees(edges).select("id", "out_degree")
    return d.orderBy(F.desc("out_degree"), "id").limit(k).collect(), d.agg(F.avg("out_degree")).first()[0], d.sample(fraction, seed)


def dangling(edges: DataFrame) -> DataFrame:
    """Nodes without an edge out of them."""
    return degrees(edges).filter("out_degree = 0").select("id")


def pagerank(edges: DataFrame, reset: float = 0.15, iterations: int = 10, weighted: bool = True, normalize: bool = True) -> DataFrame:
    """(id, rank): reset / N + (1 - reset) (sum of shares + dangling mass / N); ranks sum to 1, or to N without normalize.

    A round is one join and one aggregation: each node has a share of 0 to itself, so all come out of it.  Its result is
    written to the shared folder, and the dangling mass is observed on the way.
    """
    edges = edges.select("src", "dst", "weight") if weighted else edges.select("src", "dst").distinct().withColumn("weight", F.lit(1))
    edges = staged(edges)
    out = edges.groupBy(F.col("src").alias("from")).agg(F.sum("weight").alias("total"))
    shares = edges.join(out, F.col("src") == F.col("from")).select("src", "dst", (F.col("weight") / F.col("total")).alias("share"), F.lit(None).cast("boolean").alias("sink"))
    itself = degrees(edges).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("share"), (F.col("out_degree") == 0).alias("sink"))
    shares = staged(shares.unionByName(itself))
    unstaged(edges)
    n, sinks = shares.filter("sink is not null").agg(F.count_distinct("dst"), F.count_if("sink")).first()
    if not n:
        return shares.select(F.col("dst").alias("id"), F.lit(0.0).alias("rank"))
    ranks, lost, before = shares, sinks / n, None
    for k in range(max(iterations, 0)):
        # the first round starts from equal ranks
        given = F.col("share") / n if k == 0 else F.col("share") * F.col("rank")
        sent = shares if k == 0 else shares.join(ranks.select("id", "rank"), F.col("src") == F.col("id"))
        new = sent.groupBy(F.col("dst").alias("node")).agg((reset / n + (1 - reset) * (F.sum(given) + lost / n)).alias("rank"), F.max("sink").alias("sink")).withColumnRenamed("node", "id")
        seen = Observation()
        ranks = staged(new.observe(seen, F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)).alias("lost")))
        lost = seen.get["lost"]
        if before is not None:
            unstaged(before)
        before = ranks
    if before is None:
        ranks = shares.filter("sink is not null").select(F.col("dst").alias("id"), F.lit(1.0 / n).alias("rank")).distinct()
    else:
        unstaged(shares)
    return ranks.select("id", (F.col("rank") * (1 if normalize else n)).alias("rank"))


def pagerank_features(train: DataFrame, src: str, dst: str, **kw) -> DataFrame:
    """(id, pagerank_unweighted, pagerank_weighted) of the places in the training rows."""
    e = staged(edge_weights(train, src, dst))
    a = pagerank(e, weighted=False, **kw).withColumnRenamed("rank", "pagerank_unweighted")
    return a.join(pagerank(e, weighted=True, **kw).withColumnRenamed("rank", "pagerank_weighted"), "id", "outer")


class GraphFeatures:
    """Scores of places learned from the edges of training rows, looked up at each end of a row and of its previous one."""

    SCORES = ("pagerank_unweighted", "pagerank_weighted")

    def __init__(self, src: str = "origin", dst: str = "dest", ends: tuple[str, ...] = ("origin", "dest", "prev_flight_origin", "prev_flight_dest"), iterations: int = 10, reset: float = 0.15):
        self.src, self.dst, self.ends, self.kw = src, dst, ends, {"iterations": iterations, "reset": reset, "normalize": False}
        self.table: DataFrame | None = None

    def fit(self, train: DataFrame) -> GraphFeatures:
        self.table = staged(pagerank_features(train, self.src, self.dst, **self.kw))
        return self

    def names(self, df: DataFrame) -> list[str]:
        return [f"{c}_{s}" for c in self.ends if c in df.columns for s in self.SCORES]

    def transform(self, df: DataFrame) -> DataFrame:
        """The scores beside the rows, 0 for places not seen; rows that have them already pass as they are."""
        if all(c in df.columns for c in self.names(df)):
            return df
        return lookups(df, self.table, "id", {c: f"{c}_" for c in self.ends}, self.SCORES, 0.0)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of the node's weakly connected part, by minimum labels until nothing changes."""
    both = staged(edges.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))).distinct())
    label = staged(both.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(label, both["src"] == label["id"]).groupBy("dst").agg(F.min("component").alias("m"))
        new = staged(label.join(near, label["id"] == near["dst"], "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"), (F.coalesce("m", "component") < F.col("component")).alias("moved")))
        unstaged(label)
        if not new.filter("moved").limit(1).count():
            unstaged(both)
            return new.select("id", "component")
        # pointer jumping halves the distances that are left
        up = new.select(F.col("id").alias("__u"), F.col("component").alias("__c"))
        label = staged(new.join(up, new["component"] == up["__u"], "left").select("id", F.least("component", F.coalesce("__c", "component")).alias("component")))
        unstaged(new)


def component_sizes(labels: DataFrame) -> DataFrame:
    """(component, n), the largest first."""
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component")


def _spread(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the largest one of the nodes that link to a node has come to it, until nothing changes; links (a, b) stay inside a graph."""
    while True:
        came = links.join(label, links["a"] == label["id"]).groupBy("b").agg(F.max("color").alias("c"))
        new = staged(label.join(came, label["id"] == came["b"], "left").select("id", F.greatest("color", F.coalesce("c", "color")).alias("color"), (F.coalesce("c", "color") > F.col("color")).alias("moved")))
        if not new.filter("moved").limit(1).count():
            return new.drop("moved")
        label = new.drop("moved")


def strongly_connected(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(id, component): the greatest id of the nodes that are reached from a node and reach it.

    Each round colours the nodes that are left by the greatest one that reaches them; those that reach the node of their
    colour within it are done.  Nodes without an edge in or out are cut off first.  RuntimeError if `rounds` don't do.
    """
    left = staged(edges.select("src", "dst").filter("src <> dst").distinct())
    nodes = staged(vertices(edges))
    done = nodes.limit(0).withColumn("component", F.col("id"))
    for _ in range(rounds):
        alive = staged(left.select(F.col("src").alias("id")).intersect(left.select(F.col("dst").alias("id"))))
        cut = staged(nodes.join(alive, "id", "left_anti"))
        done = done.unionByName(cut.withColumn("component", F.col("id")))
        if not alive.limit(1).count():
            return done
        nodes = alive
        inner = lambda e: e.join(alive.withColumnRenamed("id", "src"), "src", "left_semi").join(alive.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")  # noqa: B023, E731
        left = staged(inner(left))
        if cut.limit(1).count():
            continue
        color = _spread(alive.withColumn("color", F.col("id")), left.select(F.col("src").alias("a"), F.col("dst").alias("b")))
        a, b = color.select(F.col("id").alias("src"), F.col("color").alias("ca")), color.select(F.col("id").alias("dst"), F.col("color").alias("cb"))
        same = staged(left.join(a, "src").join(b, "dst").filter("ca = cb").select("src", "dst", "ca"))
        # backwards from each colour's own node
        back = _spread(color.select("id", F.when(F.col("id") == F.col("color"), 1).otherwise(0).alias("color")), same.select(F.col("dst").alias("a"), F.col("src").alias("b")))
        found = staged(color.join(back.filter("color = 1").select("id"), "id").select("id", F.col("color").alias("component")))
        done = done.unionByName(found)
        nodes = staged(nodes.join(found, "id", "left_anti"))
        rest = lambda e, c: e.join(found.select(F.col("id").alias(c)), c, "left_anti")  # noqa: B023, E731
        left = staged(rest(rest(left, "src"), "dst").select("src", "dst"))
    raise RuntimeError(f"not done in {rounds} rounds")


def transition_matrix(edges: DataFrame, most: int = 1_000_000) -> tuple[list, np.ndarray]:
    """(nodes in order, their row-stochastic matrix) of a graph of at most `most` edges, for dense methods on the driver."""
    rows = collected(edges.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("w")), most)
    nodes = sorted({r["src"] for r in rows} | {r["dst"] for r in rows})
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for r in rows:
        m[at[r["src"]], at[r["dst"]]] = r["w"]
    total = m.sum(axis=1, keepdims=True)
    return nodes, np.divide(m, total, out=np.zeros_like(m), where=total > 0)


def power_iteration(matrix: np.ndarray, start: np.ndarray, steps: int = 50, squaring: bool = False, gap: float = 0.0) -> np.ndarray:
    """The distribution after `steps` steps of a chain; with squaring each of them doubles those done; ends early below `gap`."""
    x, m = np.asarray(start, float), np.asarray(matrix, float)
    for _ in range(steps):
        new = x @ m
        if squaring:
            new, m = np.asarray(start, float) @ m, m @ m
        if gap and np.abs(new - x).max() < gap:
            return new
        x = new
    return x
