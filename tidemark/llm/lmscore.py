"""Language-model scoring by online logistic context mixing.

A text is a sequence of words and an end.  Each is coded by binary decisions, and each decision's probability is a
logistic mix of several predictors whose weights a gate selects:

1. where the two words before were seen elsewhere in training: is this the word that followed them most often?  The
   predictors are the counts of that hashed context, and how often such guesses were right in this text, so far and of
   late;
2. if not, the path down the Huffman tree of the most frequent words.  At its heaviest nodes the predictors are the
   node's own counts, those after a class of the word before, and those after classes of two words before; below them
   the node's own counts alone;
3. for a word beyond the tree: is it in the corpus at all; then its share there, or its bytes, each by predictors of one
   to three bytes before.

Weights of 2 and 3 are learned over all training rows: a decision's predictors depend on its finest context alone, so
logistic regression over the counts of those contexts, each event taken out of its own counts, is regression over all
rows.  Weights of 1 and 2 are then refined on each text as its decisions become known, after 16, 32, 64, ... words.  A
training text is scored by what the others teach: its own occurrence is taken out of the counts of 1 and 3.  The total
is the text's log10 probability.

What is learned grows with the corpus: all contexts of two words, and the counts of all words, are kept by bucket and
meet the texts that ask for them in an exchange.  Of fixed size (parameters) are the tree of at most HEAD words, its
NODES heaviest nodes with CONTEXTS classes, and the byte contexts; these are broadcast.  All texts ask one
place about a context of two words, however many words follow it; an option splits such contexts by texts.

Beside it stands the plain unigram score, from the exact counts of all training words.

Rules for odd input: null and empty texts are the end alone; rows without an id teach nothing, and are scored with a null
id and held_out null; rows that share an id are scored each by itself; with nothing to learn from all words are unknown.
"""

from __future__ import annotations

import heapq
import itertools
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import EXCHANGE, bucket_count, chunked, exchange_batch, first_of_runs, narrow, pack, pack_rows, plan_bytes, scatter, staged, table_rows, unpack, unpack_rows
from tidemark.llm.pieces import ragged
from tidemark.llm.textcore import M1, M3, SPACED_LOWER, U64, Words, buffers, groups, mix, seeded

#: Most words in the tree.
HEAD = 1 << 17
END, START = U64(0), U64(1)  # names of the end and of what is before the first word
#: Classes of the last word and of the word before it, and tree nodes that have contexts.
CLASSES, SECOND, NODES = 1 << 10, 4, 1 << 10
CONTEXTS = CLASSES * SECOND
#: Words seen less than three times are never in the tree.
RARE = int(math.log2(3) * 16)
#: Byte contexts: the last byte, 16 classes of the one before, 4 of the one before that.
BYTES = 256 * 16 * 4
#: Bits of a context of two words beside those that choose its bucket.
KEY_BITS = 30
#: A context that more than HOT words follow in one bucket of texts is split so that a part holds at most PART requests.
HOT, PART = 64, 1 << 16
#: Gates by how often the finest context was seen.
SEEN = np.array([1, 8, 64])
#: Where learning of the weights starts: little to much seen of the longest context.
WEIGHTS = np.array([[1.0, 0.0, 0.0], [0.4, 0.5, 0.1], [0.2, 0.5, 0.3], [0.0, 0.4, 0.6]])
#: Weights of the guess by two words: its counts, this text so far, this text of late.
GUESS = np.array([0.7, 0.2, 0.4], np.float32)
RATE, LATE = 0.02, 16


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    """(names with an end after each row, rows' first tokens, the words)."""
    w = Words(raw, off, SPACED_LOWER)
    return np.insert(w.hash, w.first[1:], END), w.first + np.arange(len(w.first)), w


def before(x: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """The value of the token before in the same row, or `start`."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first[:-1]] = start
    return out


# ---------------------------------------------------------------- counts of words


def _announce_counts(n_buckets: int):
    def emit(ids: np.ndarray, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        got = []
        for lo, hi in groups(off):
            name, _, _ = tokens(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            got.append(np.unique(name, return_counts=True))
        name, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        count = np.bincount(at, np.concatenate([g[1] for g in got]), len(name)).astype(np.int64)
        yield from ((b, 0, p) for b, p in pack_rows(seeded(name, 51) % U64(n_buckets), n_buckets, name.view(np.int64), count))

    return emit


def _sum_counts(table: pa.Table) -> pa.Table:
    name, count = unpack_rows(table_rows(table, 0))
    name, at = np.unique(name.view(U64), return_inverse=True)
    count = np.bincount(at, count.astype(np.float64), len(name)).astype(np.int64)
    return pa.table({"bucket": table.column("bucket")[:1], "n": [int(count.sum())], "v": [len(name)], "once": [int((count == 1).sum())], "payload": pa.array([pack(name, count)], pa.binary())})


def _level(count: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(count) * 16).astype(np.int64)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.column("payload"):
            level, n = np.unique(_level(unpack(b.as_py())[1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(n)], ["level", "words"])


def _head_words(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("payload"):
                name, count = unpack(b.as_py())
                at = _level(count) >= least
                yield pa.RecordBatch.from_arrays([pa.array(name[at].view(np.int64)), pa.array(count[at])], ["name", "count"])

    return run


# ---------------------------------------------------------------- codes


class Codes:
    """Huffman codes of the head words, the end and the escape; inner nodes numbered by weight, heaviest first.

    The heaviest nodes, which have contexts, are the top of the tree.  A symbol's path runs through some of them to an
    exit; what follows the exit costs the same in all contexts and is added up once for each symbol.
    """

    def __init__(self, name: np.ndarray, count: np.ndarray, others: int):
        if not (name == END).any():
            name, count = np.append(name, END), np.append(count, 0)
        order = np.argsort(name)
        self.name, self.count = name[order], count[order].astype(np.int64)
        k = len(name)
        weight = np.append(np.maximum(self.count, 1), max(others, 1))
        heap = [(int(x), i) for i, x in enumerate(weight)]
        heapq.heapify(heap)
        children, total = [], list(map(int, weight))
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            children.append((i, j))
            total.append(a + b)
            heapq.heappush(heap, (a + b, len(total) - 1))
        inner = np.arange(len(children))
        total_inner = np.array(total[k + 1 :])
        rank = np.empty(len(inner), np.int64)
        rank[np.lexsort((-inner, -total_inner))] = inner  # of equal weight the later built first, so a parent is before its children
        kids = np.array(children)
        p = (np.array(total, np.float64)[kids[:, 1]] + 0.4) / (total_inner + 0.8)
        self.logit = np.empty(len(inner), np.float32)
        self.logit[rank] = np.log(p / (1 - p))
        top = self.top = min(NODES, len(inner))
        up, bit = np.full(len(total), -1), np.zeros(len(total), bool)
        up[kids[:, 0]], up[kids[:, 1]] = inner + k + 1, inner + k + 1
        bit[kids[:, 1]] = True
        at_rank = np.append(np.full(k + 1, top), rank)  # of any node
        #: For each top node its children: top nodes, or exits numbered from `top` on.
        by_rank = np.argsort(rank)[:top]
        self.child = np.empty((top, 2), np.int64)
        exit_of = np.full(len(total), -1)
        n_exit = 0
        for r in range(top):
            for b in (0, 1):
                c = kids[by_rank[r], b]
                if at_rank[c] < top:
                    self.child[r, b] = at_rank[c]
                else:
                    exit_of[c] = n_exit
                    self.child[r, b] = top + n_exit
                    n_exit += 1
        # from the leaves up: the cost below the exit, the exit, and then the path through the top
        cur, sym = np.arange(k + 1), np.arange(k + 1)
        self.below, self.exit = np.zeros(k + 1), np.full(k + 1, -1)
        while len(sym):
            at = exit_of[cur[sym]]
            done = at >= 0
            self.exit[sym[done]] = at[done]
            sym = sym[~done]
            c = cur[sym]
            z = self.logit[rank[up[c] - k - 1]].astype(np.float64)
            self.below[sym] += np.log1p(np.exp(np.where(bit[c], -z, z))) / math.log(2)
            cur[sym] = up[c]
        paths: list[list[tuple[int, int]]] = [[] for _ in range(n_exit)]
        way: list[list[tuple[int, int]]] = [[] for _ in range(top)]
        for r in range(top):  # a parent is before its children
            for b in (0, 1):
                c = int(self.child[r, b])
                (way if c < top else paths)[c if c < top else c - top] = [*way[r], (r, b)]
        self.off = np.concatenate([[0], np.cumsum([len(x) for x in paths])])
        self.node = np.array([n for x in paths for n, _ in x], np.int32)
        self.bit = np.array([b for x in paths for _, b in x], bool)
        by_count = np.empty(k + 1, np.int64)
        by_count[np.argsort(-weight, kind="stable")] = np.arange(k + 1)
        self.cls = np.where(by_count < CLASSES // 2, by_count, CLASSES // 2 + (np.append(self.name, U64(7)) % U64(CLASSES // 2 - 2)).astype(np.int64)).astype(np.int64)
        self.cls[k] = CLASSES - 1

    def symbols(self, name: np.ndarray) -> np.ndarray:
        """Symbols of names; what is not in the head is the escape, len(self.name)."""
        at = np.minimum(np.searchsorted(self.name, name), len(self.name) - 1)
        return np.where(self.name[at] == name, at, len(self.name))

    def contexts(self, sym: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The classes of the two words before, as one number; the last word's class is its high part."""
        one = before(self.cls[sym], first, CLASSES - 2)
        return one * SECOND + before(one, first, CLASSES - 2) % SECOND


def byte_events(w: Words, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context * 256 + byte, word's place in `word`) of the bytes of words, each ended by a space, which no word holds."""
    length = w.end[word] - w.start[word]
    cut = np.concatenate([[0], np.cumsum(length + 1)])
    owner = np.repeat(np.arange(len(word)), length + 1)
    k = np.arange(cut[-1]) - cut[owner]
    byte = np.where(k < length[owner], w.raw[np.minimum(w.start[word][owner] + k, len(w.raw) - 1)], 32).astype(np.int64)
    back = lambda j: np.where(k >= j, np.concatenate([np.zeros(min(j, len(byte)), np.int64), byte[: max(len(byte) - j, 0)]]), 0)
    context = back(1) * 64 + (back(2) * 167 >> 3) % 16 * 4 + (back(3) * 59 >> 5) % 4
    return context * 256 + byte, owner


def _context_counts(codes, salts: int):
    """Tables of (context, exit) and (byte context, byte), by blocks; a task's table goes to one of `salts` sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codes.value
        exits = c.top + 1
        word, byte = np.zeros(CONTEXTS * exits, np.int32), np.zeros(BYTES * 256, np.int32)
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            for lo, hi in groups(off, 2 << 20):
                name, first, w = tokens(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                sym = c.symbols(name)
                np.add.at(word, c.contexts(sym, first) * exits + c.exit[sym], np.int32(1))
                rare = np.flatnonzero(sym == len(c.name))
                if len(rare):  # words beyond the tree teach their bytes
                    np.add.at(byte, byte_events(w, rare - (np.searchsorted(first, rare, "right") - 1))[0], np.int32(1))
        salt = TaskContext.get().partitionId() % salts
        rows = []
        for kind, table, size in ((0, word, CONTEXTS // 64 * exits), (1, byte, BYTES // 64 * 256)):
            for b in range(64):
                some = table[b * size : (b + 1) * size]
                at = np.flatnonzero(some)
                if len(at):
                    rows.append(((b * 2 + kind) * salts + salt, kind, _pack_one(at, some[at])))
        yield from chunked(rows)

    return run


def _pack_one(at: np.ndarray, n: np.ndarray) -> bytes:
    return next(pack_rows(np.zeros(len(at), np.int64), 1, at, n.astype(np.int64)))[1]


def _add_tables(salts: int):
    def run(table: pa.Table) -> pa.Table:
        at, n = unpack_rows(table.column("payload").to_pylist())
        at, back = np.unique(at, return_inverse=True)
        bucket = table.column("bucket")[0].as_py() // salts
        return pa.Table.from_batches([exchange_batch([(bucket, bucket % 2, _pack_one(at, np.bincount(back, n.astype(np.float64)).astype(np.int64)))])])

    return run


# ---------------------------------------------------------------- weights


def node_counts(leaves: np.ndarray, child: np.ndarray) -> np.ndarray:
    """(context, node, bit) counts from (context, exit) counts, from the last node up."""
    top = len(child)
    out = np.zeros((len(leaves), top, 2), np.float32)
    for lo in range(0, len(leaves), 256):
        some, part = leaves[lo : lo + 256].T.astype(np.float32), np.zeros((2, top, min(256, len(leaves) - lo)), np.float32)
        for r in range(top - 1, -1, -1):
            for b in (0, 1):
                c = child[r, b]
                part[b, r] = some[c - top] if c >= top else part[0, c] + part[1, c]
        out[lo : lo + 256] = part.transpose(2, 1, 0)
    return out


#: The binary tree over 256 bytes, by bits from the highest: node 0 is the root, of node i the children are 2i + 1 and 2i + 2.
BYTE_CHILD = np.arange(1, 511).reshape(255, 2)


def _logit(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    return np.log((one + np.float32(0.4)) / (zero + np.float32(0.4)))


def learned(x: np.ndarray, bit: np.ndarray, count: np.ndarray, gate: np.ndarray, start: np.ndarray = WEIGHTS, steps: int = 30, gap: float = 1e-5, width: int = 1 << 18) -> np.ndarray:
    """Weights by gate that give the least cost of all counted decisions: Newton steps, drawn to `start` by one event's worth.

    Steps end when the cost falls by less than `gap` of itself.
    """
    out = start.copy()
    for g in range(len(start)):
        at = np.flatnonzero(gate == g)
        parts = [at[i : i + width] for i in range(0, len(at), width)]

        def cost(w: np.ndarray, slope: bool = False) -> tuple:
            total, down, curve = 0.5 * ((w - start[g]) ** 2).sum(), -(w - start[g]), np.eye(len(w))  # noqa: B023
            for some in parts:  # noqa: B023
                a, n, sign = x[some], count[some], np.where(bit[some], np.float32(1), np.float32(-1))
                z = np.clip(sign * (a @ w.astype(np.float32)), -30, 30)
                e = np.exp(-z)
                total += float((n * np.log(1 + e)).sum(dtype=np.float64))
                if slope:
                    q = e / (1 + e)
                    down = down + a.T @ (n * q * sign)
                    curve = curve + (a * (n * q * (1 - q))[:, None]).T @ a
            return total, down, curve

        w = start[g].copy()
        for _ in range(steps):
            have, down, curve = cost(w, True)
            step, size = np.linalg.solve(curve, down), 1.0
            while (new := cost(w + size * step)[0]) > have and size > 1e-3:
                size /= 2
            if new > have:
                break
            w = w + size * step
            if have - new < gap * max(1.0, abs(have)):
                break
        out[g] = w
    return out


def fit(fine: np.ndarray, per: int, base: np.ndarray | None, per_base: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(weights, gate of each finest slot, logits of the predictors, coarsest first) from (context, node, bit) counts.

    Each `per` finest contexts make a middle one; the coarsest predictor is `base`, or each `per_base` middle ones.
    """
    contexts, nodes, _ = fine.shape
    middle = fine.reshape(contexts // per, per, nodes, 2).sum(axis=1)
    if base is None:
        wide = middle.reshape(len(middle) // per_base, per_base, nodes, 2).sum(axis=1)
        coarse = _logit(wide[..., 1], wide[..., 0])
    else:
        wide, coarse = None, np.broadcast_to(base, (1, nodes))
    xs, bits, counts, gates = [], [], [], []
    for lo in range(0, contexts, 64 * per):  # some contexts at a time: temporary arrays stay small
        for b in (0, 1):
            i, j = np.nonzero(fine[lo : lo + 64 * per, :, b])
            i += lo
            own = (1 - b, b)  # the event itself is taken out
            without = lambda t, at: [t[at, j, k] - own[k] for k in (0, 1)]  # noqa: B023, E731
            f, m = without(fine, i), without(middle, i // per)
            k = coarse[0, j] if wide is None else _logit(*without(wide, i // per // per_base)[::-1])
            xs.append(np.stack([k, _logit(m[1], m[0]), _logit(f[1], f[0])], axis=1).astype(np.float32))
            bits.append(np.full(len(i), b, bool))
            counts.append(fine[i, j, b])
            gates.append(np.searchsorted(SEEN, f[0] + f[1], "right").astype(np.uint8))
    weights = learned(np.concatenate(xs), np.concatenate(bits), np.concatenate(counts), np.concatenate(gates))
    del xs, bits, counts, gates
    gate = np.searchsorted(SEEN, fine.sum(axis=2), "right").astype(np.uint8)
    return weights, gate, [coarse, _logit(middle[..., 1], middle[..., 0]).astype("<f2"), _logit(fine[..., 1], fine[..., 0]).astype("<f2")]


def byte_costs(counts: np.ndarray) -> np.ndarray:
    """Bits of each byte in each byte context, in 1/256."""
    fine = node_counts(counts.reshape(BYTES, 256), BYTE_CHILD)
    weights, gate, (one, two, three) = fit(fine, 4, None, 16)
    at = np.arange(BYTES)
    cost = np.zeros((BYTES, 511), np.float32)
    for r in range(255):
        w = weights[gate[:, r]]
        z = np.clip(one[at // 64, r].astype(np.float32) * w[:, 0] + two[at // 4, r] * w[:, 1] + three[:, r] * w[:, 2], -14, 14)
        cost[:, 2 * r + 1] = cost[:, r] + np.log1p(np.exp(z)) / math.log(2)
        cost[:, 2 * r + 2] = cost[:, r] + np.log1p(np.exp(-z)) / math.log(2)
    return np.minimum(np.round(cost[:, 255:] * 256), 65535).astype(np.uint16).ravel()


class Model:
    """What is broadcast: the tree, its contexts' logits and weights, byte costs, and totals."""

    def __init__(self, codes: Codes, words: np.ndarray, bytes_: np.ndarray, n: int, v: int, once: int):
        self.codes, self.n, self.v = codes, n, v
        self.spell = byte_costs(bytes_)
        fine = node_counts(words.reshape(CONTEXTS, codes.top + 1), codes.child)
        weights, gate, (base, middle, finest) = fit(fine, SECOND, codes.logit[: codes.top], 0)
        self.weights, self.gate = weights.astype(np.float32), gate.ravel()
        self.base, self.middle, self.finest = base[0].astype(np.float32), middle.ravel(), finest.ravel()
        #: Tokens beyond the tree, and how often the next one of them is new: those seen once among them.
        self.beyond = max(n - int(codes.count.sum()), 0)
        self.new = (once + 0.5) / (self.beyond + 1)


def _fit_model(codes, *totals: int):
    """The model from both tables, which are of fixed size; made in a task, so that the driver needs no room for it."""

    def run(table: pa.Table) -> pa.Table:
        seen = [np.zeros(CONTEXTS * (codes.value.top + 1), np.int32), np.zeros(BYTES * 256, np.int32)]
        for bucket, kind, payload in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "payload")), strict=True):
            if payload:
                at, k = unpack_rows([payload])
                seen[kind][at + bucket // 2 * (len(seen[kind]) // 64)] = np.minimum(k.astype(np.int64), (1 << 31) - 1)
        model = Model(codes.value, *seen, *totals)
        model.codes = None
        return pa.table({"payload": pa.array([pickle.dumps(model)], pa.binary())})

    return run


# ---------------------------------------------------------------- requests and answers


def context_key(name: np.ndarray, first: np.ndarray) -> np.ndarray:
    one = before(name, first, START)
    return mix(mix(one * M1) + before(one, first, START) * M3)


class Asked:
    """What a bucket of texts asks: followers of contexts (sorted, each once) and counts of words beyond the tree."""

    def __init__(self, codes: Codes, table: pa.Table, bucket: int, n_buckets: int, split: bool = True):
        table = table.combine_chunks()
        order = np.lexsort((table.column("h").to_numpy(), table.column("doc_id").fill_null(0).to_numpy(), table.column("doc_id").is_null().to_numpy(zero_copy_only=False)))
        table = table.take(pa.array(order))  # the same order whenever the bucket is read
        self.ids, self.learn = table.column("doc_id"), table.column("learn").to_numpy(zero_copy_only=False).astype(bool)
        self.raw, self.off = buffers(table.column("text"))
        names, size, context = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        for lo, hi in groups(self.off, 1 << 20):
            name, first, _ = tokens(self.raw[self.off[lo] : self.off[hi]], self.off[lo : hi + 1] - self.off[lo])
            names.append(name)
            size.append(np.diff(first))
            context.append(context_key(name, first))
        self.name, self.size = np.concatenate(names), np.concatenate(size)
        key, own = np.concatenate(context), np.repeat(self.learn, self.size)
        bits = U64(min(KEY_BITS + max(1, (n_buckets - 1).bit_length()), 47))
        low = ((self.name >> U64(40)) & U64(0xFFFF)) << U64(1) | own.astype(U64)
        full = lambda key: (key >> (U64(64) - bits)) << U64(17) | low
        entry, self.back, count = np.unique(full(key), return_inverse=True, return_counts=True)
        lead = np.flatnonzero(first_of_runs(entry >> U64(17)))
        run = np.diff(lead, append=len(entry))
        hot = (run > HOT) & (run * n_buckets > PART) & split
        if hot.any():  # such a context has parts, chosen by the bucket of texts
            parts = 1 << np.ceil(np.log2(np.maximum(run * n_buckets / PART, 1))).astype(np.int64)
            part = np.repeat(np.where(hot, 1 + bucket % parts, 0), run)[self.back]
            key = np.where(part > 0, seeded(key, 62) + mix(part.astype(U64)), key)
            entry, self.back, count = np.unique(full(key), return_inverse=True, return_counts=True)
        self.entry, self.count, self.bits = entry, np.where(entry & U64(1), count, 0), bits
        self.to = ((entry >> (U64(17) + bits - U64(32))) * U64(n_buckets) >> U64(32)).astype(np.int64) if bits >= 32 else ((entry >> U64(17)) * U64(n_buckets) >> bits).astype(np.int64)
        self.sym = codes.symbols(self.name)
        tail = np.unique(self.name[self.sym == len(codes.name)])
        home = (seeded(tail, 51) % U64(n_buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        self.tail, self.tail_to = tail[order], home[order]

    def rows(self, bucket: int) -> Iterator[tuple[int, int, bytes]]:
        key = self.entry >> U64(17)
        cuts = [*np.flatnonzero(first_of_runs(self.to)).tolist(), len(key)]
        for lo, hi in itertools.pairwise(cuts):
            step = np.diff(key[lo:hi])
            yield int(self.to[lo]), 0, pack(np.array([bucket]), key[lo : lo + 1], (step & U64(0xFFFF)).astype(np.uint16), narrow(step >> U64(16)), (self.entry[lo:hi] >> U64(1)).astype(np.uint16), narrow(self.count[lo:hi]))
        cuts = [*np.flatnonzero(first_of_runs(self.tail_to)).tolist(), len(self.tail)]  # there may be none
        for lo, hi in itertools.pairwise(cuts):
            yield int(self.tail_to[lo]), 1, pack(np.array([bucket]), self.tail[lo:hi])


def _ask(codes, n_buckets: int, split: bool = False):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        return pa.Table.from_batches(list(chunked(Asked(codes.value, table, bucket, n_buckets, split).rows(bucket))) or [exchange_batch([])])

    return run


def guess_codes(key: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per request (count 0: from a held-out text): 0 if its context was not seen elsewhere, else 1 + 2 gate + right.

    A training request leaves its own occurrence out of the counts; of equal counts the smaller word check is guessed.
    """
    cell, back = np.unique(key << U64(16) | word.astype(U64), return_inverse=True)
    n = np.bincount(back, count.astype(np.float64), len(cell)).astype(np.int64)
    lead = np.flatnonzero(first_of_runs(cell >> U64(16)))
    run = np.repeat(np.arange(len(lead)), np.diff(lead, append=len(cell)))
    most = int(n.max()) if len(n) else 0
    order = np.lexsort((most - n, run))  # stable: equal counts stay in order of the word
    total = np.add.reduceat(n, lead) if len(lead) else n
    first = order[lead]
    more = np.diff(lead, append=len(cell)) > 1
    second = np.where(more, order[np.minimum(lead + 1, len(cell) - 1)], -1)
    n1, n2 = n[first], np.where(more, n[np.maximum(second, 0)], 0)
    r, own = run[back], (count > 0).astype(np.int64)
    top = back == first[r]
    less = n1[r] - own
    stays = top & (less > 0) & ((less > n2[r]) | ((less == n2[r]) & (first[r] < second[r])))
    seen = total[r] - own
    got = np.where(top, np.where(stays, less, n2[r]), n1[r])
    return np.where(seen > 0, 1 + 2 * guess_gate(seen, got) + stays, 0).astype(np.uint8)


#: Bounds of how often a context was seen.
OFTEN = np.array([2, 3, 5, 9, 17, 65])


def guess_gate(seen: np.ndarray, got: np.ndarray) -> np.ndarray:
    share = np.minimum(4 * got // np.maximum(seen, 1), 3) + (got == seen)
    return np.searchsorted(OFTEN, seen, "right") * 5 + share


def _guess_logits() -> np.ndarray:
    """A typical context's own opinion by gate: how often its most frequent follower comes again, new ones allowed for."""
    seen = np.array([1, 2, 3.5, 6.5, 12, 35, 130])[:, None]
    share = np.array([0.15, 0.37, 0.62, 0.85, 1.0])[None, :]
    p = (seen * share) / (seen + 1.0)
    return np.log(p / (1 - p)).ravel().astype(np.float32)


GUESS_LOGIT = _guess_logits()


def _answer(left: pa.Table, right: pa.Table) -> pa.Table:
    out: list[tuple[int, int, bytes]] = []
    if sent := table_rows(left, 0):
        who, keys, words, counts = [], [], [], []
        for b in sent:
            source, lead, low, high, word, count = unpack(b)
            who.append((int(source[0]), len(word)))
            keys.append(np.concatenate([lead, lead + np.cumsum(high.astype(U64) << U64(16) | low.astype(U64))]))
            words.append(word)
            counts.append(count.astype(np.int64))
        code = guess_codes(np.concatenate(keys), np.concatenate(words), np.concatenate(counts))
        me = left.column("bucket")[0].as_py()
        cut = np.cumsum([0] + [n for _, n in who])
        out += [(source, 0, pack(np.array([me]), code[a:b])) for (source, _), a, b in zip(who, cut[:-1], cut[1:], strict=True)]
    if sent := table_rows(left, 1):
        have, count = unpack(right.column("payload")[0].as_py()) if right.num_rows else (np.zeros(0, U64), np.zeros(0, np.int64))
        me = left.column("bucket")[0].as_py()
        for b in sent:
            source, name = unpack(b)
            at = np.minimum(np.searchsorted(have, name), max(len(have) - 1, 0))
            c = np.where(have[at] == name, count[at], 0) if len(have) else np.zeros(len(name), np.int64)
            out.append((int(source[0]), 1, pack(np.array([me]), narrow(c))))
    return pa.Table.from_batches(list(chunked(out)) or [exchange_batch([])])


# ---------------------------------------------------------------- scoring


def steps(place: np.ndarray) -> np.ndarray:
    """The step a token is in by its place in the text: bounds at 16, 32, 64, ... 512, then each 512 words more."""
    low = np.searchsorted(np.array([16, 32, 64, 128, 256, 512]), place, "right")
    return np.where(place < 512, low, 5 + place // 512)


class Mixer:
    """Weights of each row by gate; costs of decisions in turn, refined after each step."""

    def __init__(self, rows: int, weights: np.ndarray):
        self.gates, self.rows = len(weights), rows
        self.weight = np.broadcast_to(weights, (rows, *weights.shape)).reshape(-1, 3).astype(np.float32)
        self.bits = np.zeros(rows)
        self.err = (np.zeros(0, np.int64), np.zeros(0), [np.zeros(0)] * 3)

    def add(self, row: np.ndarray, gate: np.ndarray, x: list[np.ndarray], bit: np.ndarray) -> None:
        key = row * self.gates + gate
        w = self.weight
        z = x[0] * w[key, 0] + x[1] * w[key, 1] + x[2] * w[key, 2]
        sign = np.where(bit, np.float32(-1), np.float32(1))
        e = np.exp(np.clip(sign * z, -14, 14))
        self.bits += np.bincount(row, np.log(1 + e), self.rows) / math.log(2)
        err = -sign * e / (1 + e)
        self.err = (key, err, x)

    def refine(self) -> None:
        key, err, x = self.err
        n = len(self.weight)
        scale = RATE / np.sqrt(np.bincount(key, minlength=n) + 16)
        for j in range(3):
            self.weight[:, j] += (scale * np.bincount(key, err * x[j], n)).astype(np.float32)


def _guesses(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(token, row, right, predictors) of the tokens whose context was seen elsewhere."""
    at = np.flatnonzero(code)
    row = np.searchsorted(first, at, "right") - 1
    right = ((code[at] - 1) & 1).astype(np.int64)
    lead = np.searchsorted(row, np.arange(len(first)))[row]  # the row's first guess
    i = np.arange(len(at))
    sums = np.concatenate([[0], np.cumsum(right)])
    opinion = lambda yes, n: np.log((yes + 0.4) / (n - yes + 0.4)).astype(np.float32)
    late = np.maximum(lead, i - LATE)
    return at, row, right.astype(bool), [GUESS_LOGIT[(code[at] - 1) >> 1], opinion(sums[i] - sums[lead], i - lead), opinion(sums[i] - sums[late], i - late)]


def _row_bits(model: Model, sym: np.ndarray, first: np.ndarray, code: np.ndarray, width: int = 1 << 16) -> np.ndarray:
    """Bits of the rows' guesses and of their paths through the top of the tree; long texts by sections of `width` words."""
    codes, rows = model.codes, len(first) - 1
    exits, context = codes.exit[sym], codes.contexts(sym, first)
    length = np.diff(codes.off)
    row_of = np.repeat(np.arange(rows), np.diff(first))
    step = steps(np.arange(len(sym)) - first[row_of])
    g_at, g_row, g_right, g_x = _guesses(code, first)
    coded = np.ones(len(sym), bool)
    coded[g_at[g_right]] = False
    guess, tree = Mixer(rows, GUESS[None, :]), Mixer(rows, model.weights)
    order = np.argsort(step, kind="stable")
    cut = np.searchsorted(step[order], np.arange(int(step.max()) + 2)) if len(order) else [0]
    g_order = np.argsort(step[g_at], kind="stable")
    g_cut = np.searchsorted(step[g_at][g_order], np.arange(len(cut)))
    for s in range(len(cut) - 1):
        some = g_order[g_cut[s] : g_cut[s + 1]]
        if len(some):
            guess.add(g_row[some], np.zeros(len(some), np.int64), [x[some] for x in g_x], g_right[some])
            guess.refine()
        at = order[cut[s] : cut[s + 1]]
        at = at[coded[at]]
        for lo in range(0, len(at), width):
            t = at[lo : lo + width]
            e = exits[t]
            token = np.repeat(t, length[e])
            place = ragged(e, codes.off)
            node, bit = codes.node[place], codes.bit[place]
            c = context[token]
            fine = c * codes.top + node
            tree.add(row_of[token], model.gate[fine].astype(np.int64), [model.base[node], model.middle[c // SECOND * codes.top + node].astype(np.float32), model.finest[fine].astype(np.float32)], bit)
            tree.refine()
    below = np.where(coded, codes.below[sym], 0)
    return guess.bits + tree.bits + np.bincount(row_of, below, rows)


RESULT = "doc_id long, n_tokens long, n_known long, base_score double, bits double"


def _score(model, n_buckets: int, split: bool = False):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m = model.value
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "bits": pa.array([], pa.float64())})
        a = Asked(m.codes, left, left.column("bucket")[0].as_py(), n_buckets, split)
        answers = [[unpack(b) for b in table_rows(right, kind)] for kind in (0, 1)]
        for got in answers:
            got.sort(key=lambda x: int(x[0][0]))
        code = np.concatenate([x[1] for x in answers[0]])[a.back]
        heard = np.concatenate([x[1].astype(np.int64) for x in answers[1]]) if answers[1] else np.zeros(0, np.int64)
        by_name = np.argsort(a.tail)
        count = np.append(m.codes.count, 0)[a.sym]
        far = np.flatnonzero(a.sym == len(m.codes.name))
        if len(far):
            count[far] = heard[by_name][np.searchsorted(a.tail[by_name], a.name[far])]
        first = np.concatenate([[0], np.cumsum(a.size)])
        base = np.add.reduceat(np.log10((count + 1) / (m.n + m.v + 1)), first[:-1])
        known = np.add.reduceat((count > 0).astype(np.int64), first[:-1])
        bits = []
        for lo, hi in groups(a.off, 512 << 10):
            x, y = first[lo], first[hi]
            total = _row_bits(m, a.sym[x:y], first[lo : hi + 1] - x, code[x:y])
            # words beyond the tree that were not guessed: their share of the corpus, or their bytes
            f = np.flatnonzero((a.sym[x:y] == len(m.codes.name)) & ((code[x:y] == 0) | ((code[x:y] - 1) & 1 == 0)))
            if len(f):
                row = np.searchsorted(first[lo : hi + 1] - x, f, "right") - 1
                c = count[x:y][f] - a.learn[lo:hi][row]
                old = c > 0
                cost = np.full(len(f), -math.log2(m.new))
                cost[old] = -np.log2((1 - m.new) * c[old] / max(m.beyond, 1))
                if not old.all():
                    w = Words(a.raw[a.off[lo] : a.off[hi]], a.off[lo : hi + 1] - a.off[lo], SPACED_LOWER, hashed=False)
                    at = np.flatnonzero(~old)
                    for some in np.array_split(at, max(1, len(at) // 50_000)):
                        event, owner = byte_events(w, f[some] - row[some])
                        cost[some] += np.bincount(owner, m.spell[event], len(some)) / 256
                total += np.bincount(row, cost, hi - lo)
            bits.append(total)
        return pa.table({"doc_id": a.ids, "n_tokens": a.size, "n_known": known, "base_score": base, "bits": np.concatenate(bits)})

    return run


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, head: int = HEAD, split: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each text.

    With `split` a context that very many words follow is guessed from a part of the texts, chosen by the number of buckets
    and so by the input's size; without it from all of them, which meet in one task.
    """
    spark = docs.sparkSession
    held = lambda c: F.crc32(F.col(c).cast("long").cast("string").cast("binary")) % parts == 2
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    train = base.filter(~held("doc_id"))
    buckets = bucket_count(base, 2 << 20)
    counts = staged(scatter(train, _announce_counts(buckets), buckets).groupBy("bucket").applyInArrow(_sum_counts, "bucket long, n long, v long, once long, payload binary"), "lm-counts")
    total = counts.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("once").alias("once")).first()
    n, v, once = (int(total[c] or 0) for c in ("n", "v", "once"))
    # the head: all words from a count level on, as many as fit
    levels = counts.mapInArrow(_levels, "level long, words long").groupBy("level").agg(F.sum("words").alias("w")).orderBy(F.desc("level")).collect()  # log counts: a few hundred at most
    least, size = 1 << 20, 0
    for r in levels:
        if size + r["w"] > head or r["level"] < RARE:
            break
        least, size = r["level"], size + r["w"]
    words = counts.mapInArrow(_head_words(least), "name long, count long").toArrow()  # at most `head`
    name, count = words.column("name").to_numpy().view(U64), words.column("count").to_numpy()
    codes = Codes(name, count, n - int(count.sum()))
    told = spark.sparkContext.broadcast(codes)
    # a task's table goes to one of some sums, and those to the last one: no sum takes more than about the root of all tasks
    salts = max(1, math.isqrt(math.ceil((plan_bytes(base) or 0) / (64 << 20))))
    tables = train.select("text").mapInArrow(_context_counts(told, salts), EXCHANGE).groupBy("bucket").applyInArrow(_add_tables(salts), EXCHANGE)
    if salts > 1:
        tables = tables.groupBy("bucket").applyInArrow(_add_tables(1), EXCHANGE)
    tables = tables.unionByName(spark.createDataFrame([(0, 0, b"")], EXCHANGE))  # nothing learned makes a model, too
    fitted = pickle.loads(tables.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fit_model(told, n, v, once), "payload binary").first()["payload"])
    fitted.codes = codes
    model = spark.sparkContext.broadcast(fitted)
    h = F.xxhash64("doc_id", "text")
    texts = base.select("doc_id", "text", h.alias("h"), F.coalesce(~held("doc_id"), F.lit(False)).alias("learn"), F.pmod(h, F.lit(buckets).cast("long")).alias("bucket")).groupBy("bucket")
    answers = texts.applyInArrow(_ask(told, buckets, split), EXCHANGE).groupBy("bucket").cogroup(counts.select("bucket", "payload").groupBy("bucket")).applyInArrow(_answer, EXCHANGE)
    rows = texts.cogroup(answers.groupBy("bucket")).applyInArrow(_score(model, buckets, split), RESULT)
    return rows.select("doc_id", held("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", (F.col("bits") * -math.log10(2)).alias("score"))


def bits_per_byte(scores: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scores with bits_per_byte: the text's bits over its bytes, null for texts without any."""
    size = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(F.coalesce(text_col, F.lit(""))).alias("b")).groupBy("doc_id").agg(F.max("b").alias("b"))
    return scores.join(size, "doc_id", "left").withColumn("bits_per_byte", F.when(F.col("b") > 0, F.col("score") / -math.log10(2) / F.col("b"))).drop("b")
