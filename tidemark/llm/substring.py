"""Substring dedup by recompression.

Every word has a 64-bit name, a hash of its bytes.  Three rounds rename the sequence of each document.  In each, first
every maximal run of one symbol becomes a symbol named by it and the run's length; then a fair coin, a hash of the name,
says whether a symbol is a left or a right one, and each left symbol followed by a right one becomes one symbol named by
both.  Names are hashes of content, so all tasks give the same names without talking to one another, and what merges
depends on neighbours alone: equal word sequences are parsed alike but for some symbols at either end.  How many is
followed through the rounds for each place: the run at an end may be longer elsewhere, and a right symbol at the start
or a left one at the end may have a partner outside.  What lies between is the interior.

A window of 20 words that occurs twice has the same interior symbols in both places.  So tasks announce their symbols by
name, repeated names come back to the documents, and only windows all of whose interior symbols occur elsewhere propose
themselves (so do those without an interior).  Proposals are equal if two independent hashes of their words agree: one
of 64 bits from the words' bytes read forwards, one of 32 bits from their bytes read backwards.  (The words themselves
are not sent.  Among the 2e13 windows of 100 TB, 0.003 pairs of different windows would be taken as equal.)

Rules for odd input: null texts have no words; a window is a repeat if an equal one has a smaller (doc_id, start); rows
that share an id are judged each by its own words, and windows at the same start of such rows are in the same place;
rows without an id have no place in the order: they lose nothing and make no other lose anything.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import EXCHANGE, bucket_count, chunked, doc_bucket, exchange_batch, first_of_runs, pack, pack_rows, scatter, table_rows, unpack, unpack_rows
from tidemark.llm.textcore import M1, SPACED, U64, Words, backward_hashes, buffers, groups, inside, mix, seeded, windows

ROUNDS = 3
#: Symbols of fewer words are taken as repeated without asking; nearly all of them are.
LEAST_SPAN = 2


def parse(h: np.ndarray, first: np.ndarray, bounds: bool = False) -> tuple[np.ndarray, ...]:
    """Names and start words of the symbols after all rounds; symbols don't cross documents.

    With `bounds` also, for each place among the words, where the interior of what starts there begins, and where the
    interior of what ends there ends.
    """
    n = len(h)
    name, start = h, np.arange(n)
    fence = np.zeros(n + 1, bool)
    fence[first] = True  # a document starts at this word
    begin, end = np.arange(n + 1), np.arange(n + 1)

    def shift(edge: np.ndarray, moves: np.ndarray) -> None:
        """Interiors lose the symbol next to them where it `moves`; `edge` has all symbols' starts, and n."""
        nonlocal begin, end
        if bounds and n:
            to = np.arange(n + 1, dtype=np.int64)
            to[edge[:-1][moves[0]]] = edge[1:][moves[0]]
            begin = to[begin]
            to = np.arange(n + 1, dtype=np.int64)
            to[edge[1:][moves[1]]] = edge[:-1][moves[1]]
            end = to[end]

    for r in range(ROUNDS):
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | fence[start[1:]]
        lead = np.flatnonzero(new)
        size = np.diff(lead, append=len(name))
        if bounds and n:  # any place inside a run moves to its end, or its start
            edge = np.append(start[lead], n)
            run = np.repeat(np.arange(len(lead)), np.diff(edge))
            begin = np.append(edge[1:], n)[np.append(run, len(lead))][begin]
            end = np.concatenate([[0], edge[run]])[end]
        name, start = name[lead], start[lead]
        many = size > 1
        name[many] = mix(mix(name[many] * M1 + size[many].astype(U64)) + U64(0xA0 + r))
        left = (seeded(name, r) >> U64(63)) == 0
        shift(np.append(start, n), (~left, left))
        joins = left[:-1] & ~left[1:] & ~fence[start[1:]]
        keep = np.ones(len(name), bool)
        keep[1:] = ~joins
        at = np.flatnonzero(joins)
        name[at] = mix(mix(name[at] * M1 + U64(r + 1)) + name[at + 1])
        name, start = name[keep], start[keep]
    return (name, start, begin, end) if bounds else (name, start)


def _emit_symbols(n_buckets: int, k: int):
    def emit(ids: np.ndarray, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        names, docs = [], []
        for lo, hi in groups(off):
            w = Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], SPACED)
            name, start = parse(w.hash, w.first)
            span = np.diff(start, append=len(w))
            doc = np.searchsorted(w.first, start, "right") - 1
            some = (span >= LEAST_SPAN) & (np.diff(w.first)[doc] >= k)
            names.append(name[some])
            docs.append(ids[lo:hi][doc[some]])
        name, doc = np.concatenate(names), np.concatenate(docs)
        order = np.lexsort((doc, name))
        name, doc = name[order], doc[order]
        new = first_of_runs(name)
        group = np.cumsum(new) - 1
        many = (np.bincount(group, minlength=int(new.sum())) > 1) if len(name) else np.zeros(0, bool)
        # known here to be repeated: documents hear of it by way of the bucket; others only need to know the name
        here = many[group] if len(name) else np.zeros(0, bool)
        once = first_of_runs(name, doc)
        pick = ~here
        bucket = lambda x: seeded(x, 77) % U64(n_buckets)
        told = np.flatnonzero(pick)
        told = told[np.argsort(doc[told], kind="stable")]
        yield from ((b, 0, p) for b, p in pack_rows(bucket(name[told]), n_buckets, doc[told], name[told]))
        known = np.flatnonzero(here & new)
        yield from ((b, 1, p) for b, p in pack_rows(bucket(name[known]), n_buckets, doc[known], name[known]))
        local = np.flatnonzero(here & once)
        local = local[np.argsort(doc[local], kind="stable")]
        for piece in np.array_split(local, max(1, len(local) // 200_000)):
            if len(piece):
                yield int(bucket(name[piece[:1]])[0]), 2, pack(doc[piece], name[piece])

    return emit


def _by_doc(doc: np.ndarray, doc_buckets: int, *columns: np.ndarray) -> pa.Table:
    """Exchange rows that carry (doc, ...) to the bucket of the document."""
    bucket = doc.astype(np.int64) % doc_buckets
    return pa.Table.from_batches([exchange_batch([(b, 0, p) for b, p in pack_rows(bucket, doc_buckets, doc, *columns)])])


def _repeated_symbols(doc_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        docs, names = [], []
        told, known = table_rows(table, 0), table_rows(table, 1)
        if told:
            doc, name = unpack_rows(told)
            sure = unpack_rows(known)[1] if known else np.zeros(0, U64)
            order = np.argsort(name, kind="stable")
            doc, name = doc[order], name[order]
            group = np.cumsum(first_of_runs(name)) - 1
            yes = (np.bincount(group) > 1)[group] | np.isin(name, sure)
            docs.append(doc[yes])
            names.append(name[yes])
        for b in table_rows(table, 2):
            doc, name = unpack(b)
            docs.append(doc)
            names.append(name)
        doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        name = np.concatenate(names) if names else np.zeros(0, U64)
        return _by_doc(doc, doc_buckets, name)

    return run


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    return table.column("doc_id").to_numpy(), *buffers(table.column("text"))


def _tags(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """What tells rows of one id apart: a checksum of their bytes."""
    data = memoryview(raw)
    return np.array([zlib.crc32(data[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.uint32)


def _candidate_windows(k: int, n_buckets: int, hash_bits: int):
    """Windows whose middle symbols are all repeated; the first of a kind in the bucket stands for the rest."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = table_rows(right, 0)
        out: list[tuple[int, int, bytes]] = []
        if left.num_rows:
            ids, raw, off = _texts(left)
            told_doc, told_name = unpack_rows(rows) if rows else (np.zeros(0, np.int64), np.zeros(0, U64))
            told = np.unique(mix(told_name ^ seeded(told_doc.view(U64), 9)))
            parts: list[list[np.ndarray]] = []
            tags = _tags(raw, off)
            for lo, hi in groups(off):
                w = Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], SPACED)
                n = len(w) - k + 1
                if n <= 0:
                    continue
                name, start, begin, end = parse(w.hash, w.first, True)
                span = np.diff(start, append=len(w))
                doc = ids[lo:hi][np.searchsorted(w.first, start, "right") - 1]
                key = mix(name ^ seeded(doc.view(U64), 9))
                yes = span < LEAST_SPAN
                if len(told):
                    yes |= told[np.minimum(np.searchsorted(told, key), len(told) - 1)] == key
                bad = np.concatenate([[0], np.cumsum(np.repeat(~yes, span))])
                x, y = begin[:n], end[k : k + n]
                i = np.flatnonzero(((x >= y) | (bad[np.maximum(x, y)] == bad[x])) & inside(w.first, k, len(w)))
                if not len(i):
                    continue
                # the second hash, of words that some proposal covers
                cover = np.zeros(len(w) + 1, np.int64)
                np.add.at(cover, i, 1)
                np.add.at(cover, i + k, -1)
                used = np.flatnonzero(cover[:-1].cumsum())
                back = np.zeros(len(w), U64)
                back[used] = backward_hashes(w, used)
                row = np.searchsorted(w.first, i, "right") - 1
                parts.append([windows(w.hash, k)[i] >> U64(64 - hash_bits), (windows(back, k)[i] >> U64(32)).astype(np.uint32), ids[lo:hi][row], i - w.first[row], tags[lo:hi][row]])
            if parts:
                h, check, doc, start, tag = (np.concatenate(c) for c in zip(*parts, strict=True))
                lead, late = _earliest(h, check, doc, start)
                send = lead[np.argsort(doc[lead], kind="stable")]
                out += [(b, 0, p) for b, p in pack_rows(seeded(h[send], 78) % U64(n_buckets), n_buckets, doc[send], h[send], check[send], start[send], tag[send])]
                for b, p in _ranges(doc[late], start[late], tag[late], n_buckets):
                    out.append((b, 1, p))
        return pa.Table.from_batches(list(chunked(out)) or [exchange_batch([])])

    return run


def _earliest(h: np.ndarray, check: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first window of each kind, all that start later than it) by both hashes."""
    order = np.lexsort((start, doc, check, h))
    lead = np.flatnonzero(first_of_runs(h[order], check[order]))
    size = np.diff(lead, append=len(order))
    first = np.repeat(order[lead], size)
    return order[lead], order[(doc[order] != doc[first]) | (start[order] != start[first])]


def _ranges(doc: np.ndarray, start: np.ndarray, tag: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """Window starts as (doc, from, length, tag) runs."""
    order = np.lexsort((start, tag, doc))
    doc, start, tag = doc[order], start[order], tag[order]
    once = first_of_runs(doc, tag, start)
    doc, start, tag = doc[once], start[once], tag[once]
    lead = np.flatnonzero(first_of_runs(doc, tag, start - np.arange(len(start))))
    yield from pack_rows(doc[lead] % n_buckets, n_buckets, doc[lead], start[lead], np.diff(lead, append=len(doc)), tag[lead])


def _late_windows(doc_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = []
        if sent := table_rows(table, 0):
            doc, h, check, start, tag = unpack_rows(sent)
            start = start.astype(np.int64)
            _, late = _earliest(h, check, doc, start)
            parts.append([doc[late], start[late], np.ones(len(late), np.int64), tag[late]])
        if known := table_rows(table, 1):
            parts.append(unpack_rows(known))
        if not parts:
            return pa.Table.from_batches([exchange_batch([])])
        doc, start, length, tag = (np.concatenate(c) for c in zip(*parts, strict=True))
        return _by_doc(doc, doc_buckets, start.astype(np.int64), length.astype(np.int64), tag)

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>"


def _apply(k: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, raw, off = _texts(left) if left.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64))
        rows = table_rows(right, 0)
        doc, start, length, tag = unpack_rows(rows) if rows else [np.zeros(0, np.int64)] * 4
        order = np.argsort(doc, kind="stable")
        doc, start, length, tag = doc[order], start[order].astype(np.int64), length[order].astype(np.int64), tag[order]
        tags = _tags(raw, off)
        cols: list[list] = [[], [], [], []]
        for lo, hi in groups(off):
            w = Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], SPACED, hashed=False)
            text = raw[off[lo] : off[hi]].tobytes()
            for r in range(lo, hi):
                a, b = w.first[r - lo], w.first[r - lo + 1]
                x, y = np.searchsorted(doc, ids[r]), np.searchsorted(doc, ids[r], "right")
                cover = np.zeros(b - a + 1, np.int64)
                if y > x:
                    mine = np.flatnonzero(tag[x:y] == tags[r]) + x  # rows that share an id have other tags
                    np.add.at(cover, start[mine], 1)
                    np.add.at(cover, start[mine] + length[mine] + k - 1, -1)
                gone = cover[:-1].cumsum() > 0
                keep = np.flatnonzero(~gone) + a
                kept = b" ".join([text[i:j] for i, j in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                cols[0].append(int(b - a))
                cols[1].append(int(gone.sum()))
                cols[2].append(hashlib.sha256(kept).hexdigest())
                cols[3].append([{"start": int(i), "end": int(j)} for i, j in edge.reshape(-1, 2)])
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "kept_sha256": pa.array(cols[2], pa.string()), "removed": pa.array(cols[3], kind)})

    return run


def repeated_spans(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 and the removed word ranges [start, end).

    A word is removed if a window of k words that covers it also starts earlier, at a smaller (doc_id, start).  Fewer
    hash_bits make the first hash collide; the second one still tells windows apart.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base, others = rows.filter("doc_id is not null"), rows.filter("doc_id is null").select("text")
    n = bucket_count(base, 4 << 20)
    names = scatter(base, _emit_symbols(n, k), n)
    replies = names.groupBy("bucket").applyInArrow(_repeated_symbols(n), EXCHANGE)
    texts = base.withColumn("bucket", doc_bucket(n)).groupBy("bucket")
    sent = texts.cogroup(replies.groupBy("bucket")).applyInArrow(_candidate_windows(k, n, hash_bits), EXCHANGE)
    late = sent.groupBy("bucket").applyInArrow(_late_windows(n), EXCHANGE)
    out = texts.cogroup(late.groupBy("bucket")).applyInArrow(_apply(k), RESULT)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.Table.from_batches([exchange_batch([])])
        for batch in batches:
            ids = pa.array(np.zeros(batch.num_rows, np.int64))
            got = _apply(k)(pa.table({"doc_id": ids, "text": batch.column("text")}), none).drop_columns(["doc_id"])
            yield from got.combine_chunks().to_batches()

    alone = others.mapInArrow(untouched, RESULT.removeprefix("doc_id long, ")).select(F.lit(None).cast("long").alias("doc_id"), "*")
    return out.unionByName(alone)
