"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, looked up in every window of the texts.

The n-grams of the benchmark are hashed once; their keys and a second, independent hash of their words go to the
executors as a Spark broadcast.  The broadcast is proven small: the benchmark's text is measured first, and where it
exceeds `max_bytes` the items are dealt into blocks below that bound and each block scans the texts by itself, so a
large benchmark costs passes, never memory.  A window whose key is found is verified word by word with the second hash.

Rows are looked at where they lie: nothing is shuffled where one block is enough, and with several the blocks' hits are
put together by id and content, so each row gives a row of its own however many share an id.

Rules for odd input: null texts and texts without words have no windows and are clean; items without words match
nothing; an item of fewer words than n is one window; rows without an id are scanned like others; equal rows give equal
results; other columns pass through whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import first_of_runs
from tidemark.llm.textcore import ALNUM_LOWER, U64, Words, backward_hashes, buffers, groups, inside, windows

#: Bytes of benchmark text in one broadcast.
MAX_BYTES = 32 << 20
#: Bits of the table that turns most windows away before the binary search.
FILTER_BITS = 20

SPAN = "array<struct<start:bigint,end:bigint>>"
FOUND = f"__words bigint, __spans {SPAN}, __items array<bigint>"


class Index:
    """The n-grams of some items, by their number of words."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        ids = np.array([i for i, _ in items], np.int64)
        w = Words(*buffers(pa.array([t for _, t in items], pa.string())), ALNUM_LOWER)
        count = np.diff(w.first)
        check = backward_hashes(w, np.arange(len(w)))
        self.by_length = {}
        for k in sorted({min(n, int(c)) for c in count if c}):
            keys, owner, words = [], [], []
            h = windows(w.hash, k)
            for row in np.flatnonzero((count == k) if k < n else (count >= n)):
                lo, hi = w.first[row], w.first[row + 1] - k + 1
                keys.append(h[lo:hi])
                owner.append(np.full(hi - lo, ids[row]))
                words.append(np.stack([check[lo + j : hi + j] for j in range(k)], axis=1))
            key, own, word = np.concatenate(keys), np.concatenate(owner), np.concatenate(words)
            order = np.argsort(key, kind="stable")
            key, own, word = key[order], own[order], word[order]
            lead = np.flatnonzero(first_of_runs(key))
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(key >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.by_length[k] = (key[lead], np.append(lead, len(key)), own, word, bits)

    def scan(self, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, window starts, items): one entry for each window of the texts and item that has it."""
        for k, (key, lead, own, word, bits) in self.by_length.items():
            h = windows(w.hash, k)
            i = np.flatnonzero(bits[(h >> U64(64 - FILTER_BITS)).astype(np.int64)])
            if not len(i):
                continue
            i = i[inside(w.first, k, len(w))[i]] if k > 1 else i
            at = np.minimum(np.searchsorted(key, h[i]), len(key) - 1)
            i, at = i[key[at] == h[i]], at[key[at] == h[i]]
            if not len(i):
                continue
            size = (lead[at + 1] - lead[at]).astype(np.int64)
            i = np.repeat(i, size)
            entry = np.repeat(lead[at], size) + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
            right = np.ones(len(i), bool)
            for j in range(k):
                used, back = np.unique(i + j, return_inverse=True)
                right &= backward_hashes(w, used)[back] == word[entry, j]
            yield k, i[right], own[entry[right]]


def _scan(index, at: int):
    """Adds FOUND to the rows of each batch; the text is column number `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(at))
            n_words, starts, stops, spans, items, per_row = [], [], [], [], [], []
            for lo, hi in groups(off):
                w = Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ALNUM_LOWER)
                n_words.append(np.diff(w.first))
                cover = np.zeros(len(w) + 1, np.int64)
                rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for k, i, item in index.value.scan(w):
                    np.add.at(cover, i, 1)
                    np.add.at(cover, i + k, -1)
                    rows.append(np.searchsorted(w.first, i, "right") - 1)
                    found.append(item)
                hit = cover[:-1].cumsum() > 0
                start = hit.copy()
                start[1:] &= ~hit[:-1]
                lead = w.first[:-1][w.first[:-1] < len(w)]
                start[lead] |= hit[lead]
                stop = hit.copy()
                stop[:-1] &= ~hit[1:] | start[1:]
                start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
                of = np.searchsorted(w.first, start, "right") - 1
                starts.append(start - w.first[of])
                stops.append(stop - w.first[of])
                spans.append(np.bincount(of, minlength=hi - lo))
                row, item = np.concatenate(rows), np.concatenate(found)
                order = np.lexsort((item, row))
                row, item = row[order], item[order]
                once = first_of_runs(row, item)
                items.append(item[once])
                per_row.append(np.bincount(row[once], minlength=hi - lo))
            flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
            cut = lambda x: pa.array(np.concatenate([[0], np.cumsum(flat(x))]).astype(np.int32))
            pairs = pa.StructArray.from_arrays([pa.array(flat(starts)), pa.array(flat(stops))], ["start", "end"])
            found = [pa.array(flat(n_words)), pa.ListArray.from_arrays(cut(spans), pairs), pa.ListArray.from_arrays(cut(per_row), pa.array(flat(items)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "__words", "__spans", "__items"])

    return run


#: Spans of several blocks: sorted, and those that touch put together.
MERGED = f"""aggregate(array_sort(s), cast(array() as {SPAN}), (acc, x) ->
    if(size(acc) > 0 and element_at(acc, -1).end >= x.start,
       concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))),
       concat(acc, array(x))))"""


def marked(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows with columns __0, __1, ... for those of docs by position, and __words, __spans and __items."""
    spark = docs.sparkSession
    text, key = f"__{docs.columns.index(text_col)}", f"__{docs.columns.index(id_col)}"
    at = docs.columns.index(text_col)
    base = docs.toDF(*[f"__{i}" for i in range(len(docs.columns))]).withColumn(text, F.col(text).cast("string"))
    tests = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).filter("item is not null and text is not null")
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, math.ceil(total / max_bytes))
    told = lambda rows: spark.sparkContext.broadcast(Index([tuple(r) for r in rows.collect()], n))
    if blocks == 1:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
        return base.mapInArrow(_scan(told(tests), at), f"{schema}, {FOUND}")
    hash_ = F.xxhash64(text).alias("__h")
    small = base.select(F.col(key).alias("__id"), text, hash_)
    schema = f"__id {small.schema['__id'].dataType.simpleString()}, `{text}` string, __h bigint, {FOUND}"
    hits = None
    for block in range(blocks):
        # an item larger than the bound would still be one item: its text is what the caller chose as a test case
        index = told(tests.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block))
        one = small.mapInArrow(_scan(index, 1), schema).select("__id", "__h", "__words", "__spans", "__items").filter(F.size("__spans") > 0)
        hits = one if hits is None else hits.unionByName(one)
    hits = hits.groupBy("__id", "__h").agg(F.flatten(F.collect_set("__spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("__items")))).alias("__items"))
    hits = hits.select("__id", F.col("__h").alias("__hh"), F.expr(MERGED).alias("__spans"), "__items")
    words = F.regexp_count(F.col(text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    out = base.withColumns({"__h": F.xxhash64(text), "__words": F.coalesce(words, F.lit(0)).cast("long")})
    out = out.join(hits, out[key].eqNullSafe(hits["__id"]) & (out["__h"] == hits["__hh"]), "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.expr(f"cast(array() as {kind})")).alias(c)
    return out.select(*base.columns, "__words", none("__spans", SPAN), none("__items", "array<bigint>"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Per document: n_words, the hit word ranges `spans` (merged, in order) and the `items` that have a window there."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return marked(base, benchmark, n, **kw).select(F.col("__0").alias("doc_id"), F.col("__words").alias("n_words"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from contamination()."""
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_documents(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows that hold no window of the benchmark, with all their columns; each is judged by its own text."""
    clean = marked(docs, benchmark, **kw).filter(F.size("__spans") == 0)
    return clean.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    raw, off = buffers(text)
    out = text.to_pylist()
    for r, found in enumerate(spans.to_pylist()):
        if out[r] is None or not found:
            continue
        t = raw[off[r] : off[r + 1]]
        w = Words(t, np.array([0, len(t)]), ALNUM_LOWER, hashed=False)
        at, kept = 0, []
        for s in found:
            kept.append(t[at : w.start[s["start"]]].tobytes())
            at = int(w.end[s["end"] - 1])
        out[r] = (b"".join(kept) + t[at:].tobytes()).decode()
    return pa.array(out, pa.string())


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows with the hit words, and what stands between them, cut out of their texts; the rest is unchanged."""
    rows = marked(docs, benchmark, text_col=text_col, **kw)
    text = docs.columns.index(text_col)
    return rows.select(*[(F.arrow_udf(_cut, "string")(F.col(f"__{i}"), F.col("__spans")) if i == text else F.col(f"__{i}")).alias(c) for i, c in enumerate(docs.columns)])
