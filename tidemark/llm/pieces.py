"""SentencePiece encoding and decoding by unigram Viterbi over a double-array trie of pieces with log scores.

No unigram model is installed: the model file is a BPE one, whose scores are negative merge ranks, not log
probabilities.  They serve as scores here, so ids and counts differ from those the library gives for this file by merges;
they are the same only after the model type in the file is set to unigram.

Texts are normalised as the model does without rules of its own: a space is put before a text that is not empty, and
spaces are written as the whitespace marker.  Inside, a space byte stands for the marker, so a marker that a text holds
itself is read as a space, as the model does.  Characters without a piece fall back to the pieces of their bytes.

No piece holds a marker after another character (checked when a model is loaded), so the best segmentation never crosses
the start of a run of spaces; nor does it cross bytes that only occur in pieces by themselves, such as line feeds.  A
batch is cut there into segments; each distinct one is segmented once, all at the same time, position by position.  Long
segments, which few would share positions with, are walked one by one in plain Python, in time that grows with their
length alone.

Rules for odd input: null texts have null pieces and count 0; the empty text has none; of equal scores the one whose
last piece is longest is taken; rows, ids and their repeats pass through as they are.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tidemark.llm.textcore import buffers, groups, word_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁".encode()
#: What an unknown character costs beyond the worst piece (fixed value of the unigram model).
UNKNOWN_PENALTY = 10.0
#: Segments of more bytes are walked by themselves.
LONG = 256


class DoubleArray:
    """A trie over byte strings: the child of state s by byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, strings: list[bytes]):
        order = sorted(range(len(strings)), key=strings.__getitem__)
        keys = [strings[i] for i in order]
        size = 4 * (sum(map(len, keys)) + 512)  # more than enough; cut to what is used at the end
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        free, fit, used = 1, 0, 1  # where the last only child and the last family were placed, the slots used
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            if lo < hi and len(keys[lo]) == depth:
                value[state] = order[lo]
                lo += 1
            if lo >= hi:
                continue
            children, at = [], lo
            while at < hi:
                c, end = keys[at][depth], at
                while end < hi and keys[end][depth] == c:
                    end += 1
                children.append((c, at, end))
                at = end
            if len(children) == 1:  # fills holes
                slot = max(free, children[0][0] + 1)
                while check[slot] >= 0:
                    slot += 1
                free, b = slot, slot - children[0][0] - 1
            else:  # next fit
                b = fit
                while any(check[b + c + 1] >= 0 for c, _, _ in children):
                    b += 1
                fit = b
            base[state] = b
            for c, x, y in children:
                check[b + c + 1] = state
                todo.append((b + c + 1, x, y, depth + 1))
            used = max(used, b + 257)
        base, check, value = (np.array(x[: used + 257], np.int32) for x in (base, check, value))
        self.base, self.check, self.value = base, check, value

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and which of them exist."""
        to = self.base[state] + byte.astype(np.int32) + 1
        return to, self.check[to] == state


class Pieces:
    """The pieces of a model file: bytes, log scores and ids, and the tries over them."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [b""] * n
        self.byte_ids = np.full(256, sp.unk_id(), np.int32)
        ids, strings, scores = [], [], []
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[b] = i
                self.text[i] = bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                s = sp.id_to_piece(i).encode().replace(MARKER, b" ")
                if b" " in s.lstrip(b" "):
                    raise ValueError(f"piece {i} has a marker inside: segments can't be cut at spaces")
                ids.append(i)
                strings.append(s)
                scores.append(sp.get_score(i))
                self.text[i] = s
        self.ids = np.array(ids, np.int32)
        self.score = np.array(scores, np.float64)
        self.unknown = min(scores) - UNKNOWN_PENALTY
        self.trie = DoubleArray(strings)
        self.reverse = DoubleArray([s[::-1] for s in strings])
        self._plain = None
        shared = {b for s in strings if len(s) > 1 for b in s}
        #: bytes below 128 that no longer piece holds: segments end before and after them
        self.alone = np.array([b < 128 and b != 32 and b not in shared for b in range(256)])
        self.single = np.array([len(s.decode()) == 1 for s in strings])
        self.piece_at = np.concatenate([[0], np.cumsum([len(t) for t in self.text])])
        self.piece_bytes = np.frombuffer(b"".join(self.text), np.uint8)


    def walk(self, text: bytes) -> tuple[array, array]:
        """For each end position of one segment: bytes of the best last piece, and its index (-1: an unknown character)."""
        if self._plain is None:
            self._plain = (*(x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.score)),)
        base, check, value, score = self._plain
        n = len(text)
        best, back, what = array("d", [-np.inf]) * (n + 1), array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        for pos in range(n):
            have = best[pos]
            if have == -np.inf:
                continue
            lead = text[pos]
            size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            known, state, at = False, 0, pos
            while at < n:
                to = base[state] + text[at] + 1
                if check[to] != state:
                    break
                state = to
                at += 1
                v = value[state]
                if v >= 0:
                    known = known or at - pos == size
                    cand = have + score[v]
                    if cand > best[at]:
                        best[at], back[at], what[at] = cand, at - pos, v
            if not known and pos + size <= n and have + self.unknown > best[pos + size]:
                best[pos + size], back[pos + size], what[pos + size] = have + self.unknown, size, -1
        return back, what

    def walked(self, text: bytes) -> np.ndarray:
        """Ids of one segment's pieces."""
        back, what = self.walk(text)
        out, at = [], len(text)
        while at > 0:
            out += [int(self.ids[what[at]])] if what[at] >= 0 else [int(self.byte_ids[text[at - 1 - j]]) for j in range(back[at])]
            at -= back[at]
        return np.array(out[::-1], np.int32)

    def walked_count(self, text: bytes) -> int:
        back, what = self.walk(text)
        n, at = 0, len(text)
        while at > 0:
            n += 1 if what[at] >= 0 else back[at]
            at -= back[at]
        return n


def char_lengths(lead: np.ndarray) -> np.ndarray:
    """Bytes of the characters that start with these bytes."""
    return 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)


class Segments:
    """The distinct segments of some rows: byte ranges in `buf`, and which segments each row is made of."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, alone: np.ndarray):
        if len(raw) >= 3 and (raw == MARKER[0]).any():
            texts = [raw[a:b].tobytes().replace(MARKER, b" ") for a, b in zip(off[:-1], off[1:], strict=True)]
            raw, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        filled = np.flatnonzero(np.diff(off) > 0)
        raw = np.insert(raw, off[filled], 32)
        grown = np.zeros(len(off), np.int64)
        grown[filled + 1] = 1
        off = off + np.cumsum(grown)
        n = len(raw)
        space, single = raw == 32, alone[raw]
        lead = np.zeros(n, bool)
        lead[off[filled]] = True
        lead[1:] |= space[1:] & ~space[:-1]
        lead |= single
        lead[1:] |= single[:-1]
        self.buf = np.concatenate([raw, np.zeros(8, np.uint8)])
        start = np.flatnonzero(lead)
        end = np.append(start[1:], n)
        self.first = np.searchsorted(start, off)
        if len(start):
            end[self.first[1:][self.first[1:] > 0] - 1] = off[1:][self.first[1:] > 0]
        h = word_hashes(self.buf, start, end)
        _, at, self.of = np.unique(h, return_index=True, return_inverse=True)
        self.start, self.length = start[at], (end - start)[at]

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.start[i] + self.length[i]].tobytes()


def viterbi(p: Pieces, seg: Segments) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all distinct segments' pieces in order, offsets by segment)."""
    n = len(seg.start)
    far = np.flatnonzero(seg.length > LONG).tolist()
    alone = {i: p.walked(seg.bytes_of(i)) for i in far}
    reach = np.where(seg.length > LONG, 0, seg.length)
    order = np.argsort(-reach, kind="stable")  # longest first: those that reach a position are a prefix
    start, length = seg.start[order], reach[order]
    at = np.concatenate([[0], np.cumsum(length + 1)])
    best = np.full(at[-1], -np.inf)
    back = np.zeros(at[-1], np.int32)  # bytes of the last piece
    what = np.full(at[-1], -1, np.int32)  # index of the last piece; -1: an unknown character
    best[at[:-1]] = 0
    for pos in range(int(length[0]) if n else 0):
        live = np.flatnonzero(best[at[:-1][: np.searchsorted(-length, -pos, "left")] + pos] > -np.inf)
        if not len(live):
            continue
        here = at[live] + pos
        have = best[here]
        size = char_lengths(seg.buf[start[live] + pos])
        known = np.zeros(len(live), bool)
        who, state, step = np.arange(len(live)), np.zeros(len(live), np.int32), 0
        while len(who):
            fits = pos + step < length[live[who]]
            who, state = who[fits], state[fits]
            state, ok = p.trie.step(state, seg.buf[start[live[who]] + pos + step])
            who, state = who[ok], state[ok]
            step += 1
            v = p.trie.value[state]
            hit = np.flatnonzero(v >= 0)
            w, v = who[hit], v[hit]
            known[w[size[w] == step]] = True
            to, cand = here[w] + step, have[w] + p.score[v]
            up = cand > best[to]
            best[to[up]], back[to[up]], what[to[up]] = cand[up], step, v[up]
        w = np.flatnonzero(~known)
        w = w[pos + size[w] <= length[live[w]]]
        to, cand = here[w] + size[w], have[w] + p.unknown
        up = cand > best[to]
        best[to[up]], back[to[up]], what[to[up]] = cand[up], size[w][up], -1
    # from the ends backwards
    row, cur = np.arange(n), length.copy()
    rows, ends, ids = [], [], []
    while len(row := row[cur[row] > 0]):
        here = at[row] + cur[row]
        v, b = what[here], back[here]
        none = v < 0
        rows.append(row[~none])
        ends.append(cur[row[~none]])
        ids.append(p.ids[v[~none]])
        for j in range(int(b[none].max()) if none.any() else 0):  # byte fallback
            x = none & (b > j)
            rows.append(row[x])
            ends.append(cur[row[x]] - j)
            ids.append(p.byte_ids[seg.buf[start[row[x]] + cur[row[x]] - 1 - j]])
        cur[row] -= b
    for i, found in alone.items():
        rows.append(np.full(len(found), np.flatnonzero(order == i)[0]))
        ends.append(np.arange(len(found)))
        ids.append(found)
    if not rows:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    row, end, piece = order[np.concatenate(rows)], np.concatenate(ends), np.concatenate(ids)
    by = np.lexsort((end, row))
    return piece[by], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])


def ragged(of: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Indices of the members of groups `of` one after another, where group g has off[g] .. off[g + 1]."""
    size = (off[1:] - off[:-1])[of]
    total = np.cumsum(size)
    return np.repeat(off[of] - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def encode(p: Pieces, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets by row) of the rows' pieces."""
    seg = Segments(raw, off, p.alone)
    ids, cut = viterbi(p, seg)
    count = np.concatenate([[0], np.cumsum(np.diff(cut)[seg.of])])
    return ids[ragged(seg.of, cut)], count[seg.first]


def decode(p: Pieces, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
    """The rows' texts as bytes: markers are spaces again, byte pieces join up, the space put in front goes."""
    data = p.piece_bytes[ragged(ids, p.piece_at)]
    at = np.concatenate([[0], np.cumsum(np.diff(p.piece_at)[ids])])[off]
    data = data.tobytes()
    return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encoded(docs: DataFrame, path: str = MODEL, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, then ids (array<int>), n_pieces and round_trip (decoding gives the text back)."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(path))  # as large as the vocabulary
    kept = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("t"))
    schema = kept.drop("t").schema.add("ids", ArrayType(IntegerType())).add("n_pieces", "long").add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces.value
        for batch in batches:
            text = batch.column("t")
            raw, off = buffers(text)
            none = text.is_null().to_numpy(zero_copy_only=False)
            for lo, hi in groups(off, 8 << 20):
                part = raw[off[lo] : off[hi]]
                ids, cut = encode(p, part, off[lo : hi + 1] - off[lo])
                whole = part.tobytes()
                same = [whole[a:b] == d for a, b, d in zip((off[lo:hi] - off[lo]).tolist(), (off[lo + 1 : hi + 1] - off[lo]).tolist(), decode(p, ids, cut), strict=True)]
                size = np.diff(cut)
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(none[lo:hi]))
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(size, pa.int64()), pa.array(same)], [*batch.schema.names[:-1], "ids", "n_pieces", "round_trip"])

    return kept.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def decoded(ids: DataFrame, path: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """All columns of `ids`, and the text that the pieces in ids_col stand for; null stays null, broken UTF-8 becomes U+FFFD."""
    pieces = ids.sparkSession.sparkContext.broadcast(Pieces(path))

    @F.arrow_udf("string")
    def text(col: pa.Array) -> pa.Array:
        flat = col.flatten().to_numpy(zero_copy_only=False)
        size = np.array([0 if x is None else x for x in pc.list_value_length(col).to_pylist()], np.int64)
        rows = decode(pieces.value, flat, np.concatenate([[0], np.cumsum(size)]))
        return pa.array([None if n else r.decode(errors="replace") for r, n in zip(rows, col.is_null().to_pylist(), strict=True)], pa.string())

    return ids.withColumn(text_col, text(F.col(ids_col).cast("array<int>")))


# ---------------------------------------------------------------- counts by a trie of pre-tokens


def terminal_counts(p: Pieces, seg: Segments) -> np.ndarray:
    """Pieces of each distinct segment, by forward scores over a trie of the segments: a shared prefix is scored once.

    Nodes of one depth are scored together.  From each, the pieces that end there are found by walking the reversed
    pieces' trie up the parents, whose scores are known already.
    """
    n = len(seg.start)
    counts = np.zeros(n, np.int64)
    for i in np.flatnonzero(seg.length > LONG).tolist():  # no trie: nothing to share along so long a segment
        counts[i] = p.walked_count(seg.bytes_of(i))
    order = np.argsort(-seg.length, kind="stable")
    order = order[seg.length[order] <= LONG]
    n = len(order)
    start, length = seg.start[order], seg.length[order]
    left, chars = np.zeros(1, np.int64), np.zeros(1, np.int64)
    best, count = np.zeros(1), np.zeros(1, np.int64)
    up, label = np.zeros(1, np.int64), np.zeros(1, np.uint8)
    node = np.zeros(n, np.int64)
    for depth in range(1, int(length[0]) + 1 if n else 0):
        live = int(np.searchsorted(-length, -depth, "right"))
        key = node[:live] * 256 + seg.buf[start[:live] + depth - 1]
        new, inverse = np.unique(key, return_inverse=True)
        base = len(up)
        node[:live] = base + inverse
        par, lab = new >> 8, (new & 255).astype(np.uint8)
        up, label = np.append(up, par), np.append(label, lab)
        inner = (lab & 0xC0) == 0x80
        size = np.where(inner, chars[par], char_lengths(lab))
        rest = np.where(inner, left[par] - 1, size - 1)
        chars, left = np.append(chars, size), np.append(left, rest)
        score, pieces = np.full(len(new), -np.inf), np.zeros(len(new), np.int64)
        known = np.zeros(len(new), bool)
        who = np.flatnonzero(rest == 0)
        cur, state, step = base + who, np.zeros(len(who), np.int32), 0
        while len(who):
            state, ok = p.reverse.step(state, label[cur])
            who, cur, state = who[ok], up[cur[ok]], state[ok]
            step += 1
            v = p.reverse.value[state]
            hit = np.flatnonzero(v >= 0)
            w, v, c = who[hit], v[hit], cur[hit]
            known[w[size[w] == step]] = True
            cand = best[c] + p.score[v]
            better = (cand >= score[w]) & (cand > -np.inf)  # of equal ones the longest, which comes last
            score[w[better]], pieces[w[better]] = cand[better], count[c[better]] + 1
            more = cur > 0
            who, cur, state = who[more], cur[more], state[more]
        w = np.flatnonzero(~known & (rest == 0))
        c = base + w
        for j in range(4):
            c = np.where(j < size[w], up[np.minimum(c, len(up) - 1)], c)
        cand = best[np.minimum(c, len(best) - 1)] + p.unknown
        better = cand > score[w]
        score[w[better]], pieces[w[better]] = cand[better], count[c[better]] + size[w[better]]
        best, count = np.append(best, score), np.append(count, pieces)
        done = slice(int(np.searchsorted(-length, -depth, "left")), live)
        counts[order[done]] = count[node[done]]
    return counts


def token_counts(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens: how many pieces the best unigram segmentation of each text has; null texts have 0."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column("t"))
            out = [np.zeros(0, np.int64)]
            for lo, hi in groups(off, 8 << 20):
                seg = Segments(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], pieces.value.alone)
                total = np.concatenate([[0], np.cumsum(terminal_counts(pieces.value, seg)[seg.of])])
                out.append(np.diff(total[seg.first]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out), pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, n_tokens long")
