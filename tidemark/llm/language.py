"""Language identification by multilingual mixture inference.

Training counts letter trigrams by language over all labelled texts.  For each document expectation-maximisation finds
the proportions of the languages its words come from; the number of languages is the one whose likelihood, less a
penalty for each language, is greatest.  The prediction is the language with the largest proportion, its score.

Rules for odd input: texts that are null or without a letter are `und` with score 0, and so is everything if nothing was
learned; of equal proportions the alphabetically first language wins; rows without an id count as not held out where
they are learned from and are predicted like the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pack, plan_bytes, unpack
from tidemark.llm.textcore import Words, _table, buffers, groups

BITS = 16
#: Letters and everything beyond ASCII; what is left stands between words.
LETTERS = _table({*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}, lower=True)
#: Steps end for a document once no proportion moves by more than TOLERANCE; STEPS bounds them.
TOLERANCE, STEPS = 2e-3, 200
#: Languages whose counts a task holds at once; beyond, what it has counted is sent on.
HELD = 64
#: Log-likelihood a further language must add, beside half the log of the number of words.
PENALTY = 6.0


def held_out(id_col: Column, parts: int, which: int = 2) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == which, F.lit(False))


def trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, trigram codes in order, words' first codes): each letter with both neighbours, word ends as spaces."""
    w = Words(raw, off, LETTERS, hashed=False)
    n = len(raw)
    size = w.end - w.start
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(w.start - first[:-1], size) + np.arange(first[-1])
    b = w.raw.astype(np.uint32)
    before, after = np.full(n, 32, np.uint32), np.full(n, 32, np.uint32)
    before[1:], after[:-1] = b[: max(n - 1, 0)], b[1 : max(n, 1)]
    before[w.start], after[w.end - 1] = 32, 32
    code = (before[at] << np.uint32(16)) | (b[at] << np.uint32(8)) | after[at]
    return w, (code * np.uint32(2654435761)) >> np.uint32(32 - BITS), first


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [language, trigram]) from the labelled rows that aren't held out."""
    rows = docs.filter(~held_out(F.col(id_col), parts)).select(F.lower(F.col(text_col).cast("string")).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")

    def sparse(total: dict[str, np.ndarray], salt: int) -> pa.RecordBatch:
        at = [np.flatnonzero(c) for c in total.values()]
        payload = [pack(i.astype(np.uint16), c[i]) for i, c in zip(at, total.values(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(np.full(len(total), salt, np.int32)), pa.array(payload, pa.binary())], ["lang", "salt", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        salt = TaskContext.get().partitionId() % salts
        for batch in batches:
            names, which = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            raw, off = buffers(batch.column("text"))
            for lo, hi in groups(off):
                w, code, first = trigrams(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                ends = first[w.first]  # the first trigram of each row
                for n in np.unique(which[lo:hi]):
                    mine = [code[ends[r] : ends[r + 1]] for r in np.flatnonzero(which[lo:hi] == n)]
                    c = np.bincount(np.concatenate(mine), minlength=1 << BITS)
                    name = str(names[n])
                    total[name] = total[name] + c if name in total else c
                    if len(total) >= HELD:
                        yield sparse(total, salt)
                        total = {}
        yield sparse(total, salt)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << BITS, np.int64)
        for b in table.column("counts"):
            at, n = unpack(b.as_py())
            total[at] += n
        at = np.flatnonzero(total)
        return pa.table({"lang": table.column("lang")[:1], "salt": pa.array([0], pa.int32()), "counts": pa.array([pack(at.astype(np.uint16), total[at])], pa.binary())})

    # a language's rows meet in `salts` places first, and those sums, which are of a fixed size, in one
    salts = max(1, math.isqrt(math.ceil((plan_bytes(rows) or 0) / (64 << 20))))
    kind = "lang string, salt int, counts binary"
    sums = rows.mapInArrow(count, kind).groupBy("lang", "salt").applyInArrow(add, kind)
    if salts > 1:
        sums = sums.groupBy("lang").applyInArrow(add, kind)
    dense = lambda b: np.bincount(unpack(b)[0], unpack(b)[1].astype(np.float64), 1 << BITS)
    found = sorted(((r["lang"], dense(r["counts"])) for r in sums.collect()), key=lambda x: x[0])  # a table of fixed size for each language
    table = np.array([c for _, c in found], np.float64).reshape(len(found), 1 << BITS) + 0.5
    return [name for name, _ in found], np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def mixture(ll: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Language proportions [document, language] from words' log-likelihoods [word, language]."""
    n, k = len(first) - 1, ll.shape[1]
    size = np.diff(first)
    out = np.zeros((n, k))
    some = np.flatnonzero(size)
    if not len(some) or not k:
        return out
    total = np.add.reduceat(ll, first[some], axis=0)
    best = total.argmax(axis=1)
    out[some, best] = 1
    rel = ll - ll.max(axis=1, keepdims=True)
    peak = np.add.reduceat(ll.max(axis=1), first[some])
    gain = peak - total[np.arange(len(some)), best]  # the most that further languages could add
    fine = penalty + 0.5 * np.log(size[some] + 1)
    open_ = some[gain > fine]
    if not len(open_) or k == 1:
        return out
    words = np.concatenate([np.arange(a, b) for a, b in zip(first[open_], first[open_ + 1], strict=True)])
    doc = np.repeat(np.arange(len(open_)), size[open_])
    like = np.exp(rel[words].astype(np.float64))
    cut = np.concatenate([[0], np.cumsum(size[open_])[:-1]])

    def em(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pi = allowed / allowed.sum(axis=1, keepdims=True)
        live, words_, of, at = np.arange(len(open_)), like, doc, cut
        for _ in range(STEPS):  # each document by itself: those that are done step out
            old = pi[live]
            r = old[of] * words_ + 1e-300
            r /= r.sum(axis=1, keepdims=True)
            new = np.add.reduceat(r, at, axis=0) / size[open_[live]][:, None] * allowed[live]
            new /= new.sum(axis=1, keepdims=True)
            pi[live] = new
            moves = np.abs(new - old).max(axis=1) > TOLERANCE
            if not moves.any():
                break
            if not moves.all():
                words_ = words_[moves[of]]
                live = live[moves]
                n_ = size[open_[live]]
                of, at = np.repeat(np.arange(len(live)), n_), np.cumsum(n_) - n_
        return pi, np.add.reduceat(np.log((pi[doc] * like).sum(axis=1) + 1e-300), cut)

    pi, _ = em(np.ones((len(open_), k)))
    rank = np.argsort(np.argsort(-pi, axis=1, kind="stable"), axis=1)
    single = np.add.reduceat(rel[words].astype(np.float64), cut, axis=0)
    chosen, value = out[open_], single.max(axis=1)
    for count in range(2, k + 1):
        pi_k, fit = em((rank < count).astype(float))
        better = fit - (count - 1) * fine[np.searchsorted(some, open_)] > value
        chosen[better], value[better] = pi_k[better], (fit - (count - 1) * fine[np.searchsorted(some, open_)])[better]
    out[open_] = chosen
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", parts: int = 4, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the chosen languages with their proportions."""
    names, table = model
    held = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))  # 2^16 trigrams x languages
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), parts).alias("held_out"), F.lower(F.col(text_col).cast("string")).alias("text"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            pred, score, mix_names, mix_parts = [], [], [], []
            for lo, hi in groups(off, 1 << 20):
                w, code, first = trigrams(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                ll = np.add.reduceat(held.value[code], first[:-1], axis=0) if len(w) else np.zeros((0, len(names)), np.float32)
                pi = mixture(ll, w.first, penalty)
                for r in range(hi - lo):
                    known = bool(letters[lo + r]) and bool(names) and pi[r].any()
                    top = int(pi[r].argmax()) if known else -1
                    pred.append(names[top] if known else "und")
                    score.append(float(pi[r, top]) if known else 0.0)
                    used = np.flatnonzero(pi[r] > 0) if known else []
                    mix_names.append([names[i] for i in used])
                    mix_parts.append([float(pi[r, i]) for i in used])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix_names, pa.list_(pa.string())), pa.array(mix_parts, pa.list_(pa.float64()))],
                ["doc_id", "held_out", "lang_pred", "score", "languages", "proportions"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>")


def determined(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """The rows of docs, as they are, whose prediction isn't `und`: each is judged by its own text, whatever its id."""
    names, table = model
    held = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))
    width = len(docs.columns)
    rows = docs.select("*", F.lower(F.col(text_col).cast("string")).alias("__lower"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("__letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.column(width + 1).to_numpy(zero_copy_only=False).astype(bool)
            raw, off = buffers(batch.column(width))
            for lo, hi in groups(off, 1 << 20):
                w, code, first = trigrams(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                ll = np.add.reduceat(held.value[code], first[:-1], axis=0) if len(w) else np.zeros((0, len(names)), np.float32)
                keep[lo:hi] &= mixture(ll, w.first, penalty).any(axis=1)
            yield batch.select(list(range(width))).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4) -> DataFrame:
    """Learn from the rows of docs that aren't held out and predict all of them."""
    return predict(docs, learn(docs, id_col, text_col, lang_col, parts), id_col, text_col, parts)


