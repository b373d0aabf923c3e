"""N-gram Jaccard join by a token-group matrix, exact, as connected classes.

1. Each text becomes its set of shingle hashes.  Texts with equal sets in one batch are represented by one.
2. Routing keys.  Sets of like size deal their tokens into m buckets, where m exceeds the largest symmetric difference
   that the similarity allows between them; so two similar sets have a bucket with exactly the same tokens.  A set has
   one key for each bucket: a hash of the bucket's tokens.  Empty buckets would make keys that everyone shares: m is
   raised by an allowance for them, and only the few sets with more empty buckets than that announce them.
3. Groups.  Sets that share a key are compared with the first of them; what is similar forms groups.
4. Token-group matrix.  Where sets that share a key ended in different groups, a matrix holds the union of the tokens of
   each group's members, hashed to a row of bits.  The cells of a set that a row lacks bound its overlap with every
   member of the group; groups whose bound falls short stay closed.
5. Groups that qualify are opened: members that the parities of their cells don't rule out are verified, first as many
   as connect the groups of a key, then, under the groups this gives, every pair that is left.

Nothing is capped: whatever the bound can't rule out is verified by its true intersection and union.

Rules for odd input: null texts and texts without words have an empty set and are linked with nothing; a text of fewer
words than the shingle is one shingle; rows without an id are linked with nothing and have no class; rows that share an
id form one node of the graph, with the links of all of them, and each gives a row of its own.  Where one document of
each class is to stay, rows that share an id are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, bucket_count, first_of_runs, ids_shared, keyed, numbered, pack, pack_rows, scatter, staged, table_rows, unpack, unpack_rows
from tidemark.llm.components import connected
from tidemark.llm.textcore import SPACED_LOWER, U64, Words, buffers, groups, seeded, windows

#: Sizes of one class differ by this factor at most.
STEP = 1.5
#: Cells of a row of the token-group matrix, and sets of one key that are looked at together.
BITS, TILE = 1024, 4096


class Scheme:
    """Bucket numbers for each class of set sizes, for similarity num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self._classes: list[tuple[int, int, int]] = []  # (smallest size, buckets, allowed empty buckets)
        self._next = 1

    def _grow(self, size: int) -> None:
        while self._next <= size:
            lo = self._next
            hi = max(lo, int(lo * STEP), lo * self.den // self.num)  # a partner is in the same or a neighbouring class
            most = self.differences(hi, hi * self.den // self.num)
            m = most + 1
            spare = min(m, int(np.ceil(3 * m * np.exp(-lo / m)))) if most else 0
            self._classes.append((lo, most + 1 + spare, spare))
            self._next = hi + 1

    def differences(self, a: int, b: int) -> int:
        """The largest symmetric difference of similar sets of sizes a and b."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def classes(self, size: int) -> list[tuple[int, int, int]]:
        """(class, buckets, spare) in which a set of this size announces itself: its own, and the one below if a partner may be there."""
        self._grow(size)
        k = max(i for i, c in enumerate(self._classes) if c[0] <= size) if len(self._classes) < 8 else int(np.searchsorted([c[0] for c in self._classes], size, "right")) - 1
        out = [(k, *self._classes[k][1:])]
        if k and -(-size * self.num // self.den) < self._classes[k][0]:
            out.append((k - 1, *self._classes[k - 1][1:]))
        return out


def shingle_sets(ids: np.ndarray, raw: np.ndarray, off: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each row."""
    for lo, hi in groups(off):
        w = Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], SPACED_LOWER)
        full = windows(w.hash, k)
        for r in range(lo, hi):
            a, b = int(w.first[r - lo]), int(w.first[r - lo + 1])
            if b - a >= k:
                yield r, np.unique(full[a : b - k + 1])
            else:
                yield r, windows(w.hash[a:b], b - a) if b > a else np.zeros(0, U64)


def keys_of(tokens: np.ndarray, scheme: Scheme) -> list[np.ndarray]:
    """The routing keys of a set."""
    out = []
    value = seeded(tokens, 11)
    for level, m, spare in scheme.classes(len(tokens)):
        bucket = (seeded(tokens, 12) % U64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sorted_buckets = bucket[order]
        cut = np.flatnonzero(first_of_runs(sorted_buckets))
        total = np.add.reduceat(value[order], cut)  # a sum doesn't depend on the order
        named = sorted_buckets[cut]
        salt = seeded(np.array([level], np.int64).view(U64), 13)[0]
        out.append(seeded(total ^ salt, 14) ^ seeded(named.view(U64), 15))
        if m - len(cut) > spare:
            empty = np.setdiff1d(np.arange(m), named)
            out.append(seeded(np.full(len(empty), salt), 16) ^ seeded(empty.view(U64), 15))
    return out


META, KEYS = -1, 0


def _announce(k: int, num: int, den: int, n_buckets: int):
    scheme = Scheme(num, den)

    def emit(ids: np.ndarray, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        size = np.zeros(len(ids), np.int64)
        rep = ids.copy()
        seen: dict[tuple[int, int, int], int] = {}
        sets: dict[int, list[np.ndarray]] = {}
        for r, tokens in shingle_sets(ids, raw, off, k):
            size[r] = len(tokens)
            if not len(tokens):
                continue
            print_ = (len(tokens), int(tokens.sum(dtype=U64)), int(np.bitwise_xor.reduce(seeded(tokens, 17))))
            if print_ in seen:
                rep[r] = ids[seen[print_]]
                continue
            seen[print_] = r
            sets[r] = keys_of(tokens, scheme)
        row = np.repeat(list(sets), [sum(map(len, v)) for v in sets.values()]).astype(np.int64) if sets else np.zeros(0, np.int64)
        key = np.concatenate([x for v in sets.values() for x in v]) if sets else np.zeros(0, U64)
        yield from ((b, KEYS, p) for b, p in pack_rows(seeded(key, 18) % U64(n_buckets), n_buckets, ids[row], key))
        yield int(abs(int(ids[0])) % n_buckets), META, pack(ids, size, rep)

    return emit


def _stars(table: pa.Table) -> pa.Table:
    """In a bucket of keys: (key, doc, leader) for those who share a key; sizes and copies pass through as (doc, size, rep)."""
    meta = [unpack(b) for b in table_rows(table, META)]
    ids, size, rep = (np.concatenate(x) for x in zip(*meta, strict=True)) if meta else [np.zeros(0, np.int64)] * 3
    passed = pa.table({"kind": np.full(len(ids), META, np.int32), "x": ids, "y": size, "z": rep})
    rows = table_rows(table, KEYS)
    if not rows:
        return passed
    doc, key = unpack_rows(rows)
    order = np.lexsort((doc, key))
    doc, key = doc[order], key[order]
    once = first_of_runs(key, doc)
    doc, key = doc[once], key[once]
    lead = np.flatnonzero(first_of_runs(key))
    size = np.diff(lead, append=len(key))
    some = np.repeat(size > 1, size)
    leader = np.repeat(doc[lead], size)
    return pa.concat_tables([passed, pa.table({"kind": np.full(int(some.sum()), KEYS, np.int32), "x": key[some].view(np.int64), "y": doc[some], "z": leader[some]})])


def verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The rows (a, b) of distinct pairs whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 500):  # the sets of so many pairs are held at once
                batch = whole.slice(lo, 500)
                sides = [[s for _, s in shingle_sets(np.zeros(len(batch), np.int64), *buffers(batch.column(side)), k)] for side in ("ta", "tb")]
                both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides, strict=True)], np.int64)
                total = np.array([len(x) + len(y) for x, y in zip(*sides, strict=True)], np.int64)
                yield batch.select(["a", "b"]).filter(pa.array((both * den >= num * (total - both)) & (both > 0)))

    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(ta.hint("merge"), "a").join(tb.hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _sketches(k: int):
    """Bit rows of the sets: which of BITS cells the tokens fall into, and the parity of their number in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            size, held, parity = [], [], []
            for _, tokens in shingle_sets(ids, *buffers(batch.column("text")), k):
                count = np.bincount((seeded(tokens, 19) % U64(BITS)).astype(np.int64), minlength=BITS)
                size.append(len(tokens))
                held.append(np.packbits(count > 0).tobytes())
                parity.append(np.packbits((count & 1).astype(bool)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size, pa.int64()), pa.array(held, pa.binary()), pa.array(parity, pa.binary())], ["s_id", "n", "held", "parity"])

    return run


def _open_groups(num: int, den: int, whole: bool):
    """Token-group matrices of the keys in a bucket: a row for each group, the union of its members' cells.

    A set of n tokens, u of whose cells are not in a group's row, has at most n - u tokens in common with any member.
    Groups that qualify are opened: members stay if the parities allow the difference.  With `whole` all such pairs
    are returned, else as many as connect the groups.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, i, j, own, doc, g, n = (table.column(c).to_numpy() for c in ("key", "i", "j", "own", "doc", "g", "n"))
        bits = [np.frombuffer(b"".join(table.column(c).to_pylist()), U64).reshape(len(key), -1) for c in ("held", "parity")]
        order = np.lexsort((doc, g, own, j, i, key))
        cuts = np.append(np.flatnonzero(first_of_runs(key[order], i[order], j[order])), len(order))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[lo:hi]
            lead = np.flatnonzero(first_of_runs(g[at], own[at]))
            matrix = np.bitwise_or.reduceat(bits[0][at], lead, axis=0)
            group_of = np.repeat(np.arange(len(lead)), np.diff(lead, append=len(at)))
            cut = np.append(lead, len(at))
            us, vs = [], []
            for a in range(0, len(at), 64):
                q = at[a : a + 64]
                missing = np.bitwise_count(bits[0][q][:, None, :] & ~matrix[None]).sum(axis=2, dtype=np.int64)
                opens = (n[q][:, None] - missing) * den >= n[q][:, None] * num
                opens &= g[at[lead]][None, :] < g[q][:, None]
                if i[at[0]] != j[at[0]]:  # a pair of tiles: only what meets across
                    opens &= own[at[lead]][None, :] != own[q][:, None]
                r, c = np.nonzero(opens)
                size = cut[c + 1] - cut[c]
                r = np.repeat(r, size)
                m = np.repeat(cut[c], size) + np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)
                u, v = q[r], at[m]
                both = n[u] + n[v]
                fits = np.minimum(n[u], n[v]) * den >= num * np.maximum(n[u], n[v])
                u, v, both, r, m = u[fits], v[fits], both[fits], r[fits], m[fits]
                close = np.bitwise_count(bits[1][u] ^ bits[1][v]).sum(axis=1, dtype=np.int64) <= both * (den - num) // (den + num)
                us.append(a + r[close])
                vs.append(m[close])
            u, v = np.concatenate(us), np.concatenate(vs)
            if not whole and len(u):
                keep = _spanning(group_of[u], group_of[v], len(lead))
                u, v = u[keep], v[keep]
            found.append((doc[at[u]], doc[at[v]]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 2
        if len(a):
            a, b = np.unique(np.stack([a, b]), axis=1)
        return pa.table({"a": a, "b": b})

    return run


def _spanning(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """Indices of links that make a spanning forest."""
    root, keep = list(range(nodes)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            keep.append(k)
    return np.array(keep, np.int64)


def similar_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest id reachable by links of similarity num / den or more."""
    if not 0 < num <= den:
        raise ValueError("the similarity is num / den, above 0 and at most 1")
    with Scratch(docs.sparkSession) as scratch:
        classes = scratch.keep(_classes(keyed(docs, id_col, text_col), k, num, den))
    alone = docs.filter(F.col(id_col).isNull()).select(F.col(text_col).cast("string").alias("text"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [len(t) for _, t in shingle_sets(np.zeros(len(batch), np.int64), *buffers(batch.column("text")), k)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["n_shingles"])

    none = F.lit(None).cast("long")
    return classes.unionByName(alone.mapInArrow(sizes, "n_shingles long").select(none.alias("doc_id"), "n_shingles", none.alias("component_id")))


def _classes(base: DataFrame, k: int, num: int, den: int) -> DataFrame:
    n = bucket_count(base, 4 << 20)
    sent = scatter(base, _announce(k, num, den, n), n).groupBy("bucket").applyInArrow(_stars, "kind int, x long, y long, z long")
    sent = staged(sent, "jaccard-shared")
    shared = sent.filter(F.col("kind") == KEYS).select(F.col("x").alias("key"), F.col("y").alias("doc"), F.col("z").alias("leader"))
    meta = sent.filter(F.col("kind") == META).select(F.col("x").alias("doc_id"), F.col("y").alias("n_shingles"), F.col("z").alias("rep"))

    # Groups: everyone against the first of those who share a key.  Copies within a batch are links as they stand.
    near = shared.select(F.col("doc").alias("doc_id")).distinct()
    texts = staged(base.join(near, "doc_id", "left_semi"), "jaccard-texts")
    pairs = shared.filter("doc <> leader").select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct()
    copies = meta.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = staged(verified(pairs, texts, k, num, den).unionByName(copies), "jaccard-links")
    groups_ = staged(connected(links), "jaccard-groups")

    # Matrix: only keys whose sets are in different groups.  The first time a key gives a forest over its groups, which
    # unites nearly all that belongs together; the second time every pair that passes is verified.
    sketches = staged(texts.mapInArrow(_sketches(k), "s_id long, n long, held binary, parity binary").distinct(), "jaccard-sketches")  # of each text of an id
    final = groups_
    for whole in (False, True):
        placed = shared.select("key", "doc").join(final, shared["doc"] == final["id"], "left").select("key", "doc", F.coalesce("component", "doc").alias("g"))
        split = placed.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi").select("key")
        mixed = staged(placed.join(split, "key"), "jaccard-mixed")
        tiles = mixed.groupBy("key").count().filter(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).cast("long").alias("tiles"))
        rows = mixed.join(staged(tiles, "jaccard-tiles"), "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("g"), "tiles")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        rows = rows.select("key", "doc", "g", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        rows = rows.join(sketches, rows["doc"] == sketches["s_id"]).withColumn("bucket", F.pmod(F.xxhash64("key", "i", "j"), F.lit(n)))
        opened = rows.groupBy("bucket").applyInArrow(_open_groups(num, den, whole), "a long, b long").distinct()
        links = staged(links.unionByName(verified(opened.join(pairs, ["a", "b"], "left_anti"), texts, k, num, den)), "jaccard-links")
        final = staged(connected(links), "jaccard-groups")
    return staged(meta.join(final, meta["doc_id"] == final["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "jaccard-classes")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One document of each class, that of the smallest id, with all its columns; rows without an id stay."""
    with Scratch(docs.sparkSession) as scratch:
        key, rows = id_col, docs
        if ids_shared(docs, id_col):
            key, rows = "__row", scratch.keep(numbered(docs, id_col, text_col))
        classes = similar_classes(rows, id_col=key, text_col=text_col, **kw)
        late = scratch.keep(staged(classes.filter("component_id <> doc_id").select(F.col("doc_id").alias("__late_id")).distinct(), "jaccard-late"))
    return rows.join(late, F.col(key) == F.col("__late_id"), "left_anti").select(*docs.columns)
