"""Line dedup by an exact set-similarity join.

The tokens of a line are its distinct lower-cased words, ordered by rarity; rarity is counted over all lines into a table
of fixed size (words that share a cell share a count, which changes the order but not its being one).  Two lines whose
sets are similar share a token among their first few, so lines meet in the tokens of that prefix; pairs must pass the
length filter, the positional filter and a bound on the symmetric difference from parity bits (twice 64, or 256
where both lines are long), and those left are verified by their Jaccard similarity.  A line is removed if it is similar to one before it, at a smaller (doc_id, line),
whether that one is itself removed or not.

Equal lines are settled first: of equal sets in a batch only the first travels, and in a token's group again.

Rules for odd input: lines end at line feeds; lines without words are never removed; null texts have no lines and stay
null; rows without an id keep their text and take no part; rows that share an id are judged each by itself, in order of
their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, bucket_count, first_of_runs, ids_shared, keyed, numbered, pack, pack_rows, scatter, staged, table_rows, unpack, unpack_rows
from tidemark.llm.pieces import ragged
from tidemark.llm.textcore import SPACED_LOWER, U64, Words, buffers, groups, seeded

CELLS = 1 << 18
PASSED, ENTRY = -1, 0
#: Pairs looked at in one pass.
PAIRS = 1 << 21
#: Lines of more tokens than this have 256 parity bits, in four words that add up without carry to the 64 bits of all lines; the others have 64 bits of another hash.
WIDE = 32
#: Bits of the table of lines with candidates (a fixed size; once it is full all lines travel to verification).
LINE_BITS = 1 << 24


def line_words(raw: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words with lines as rows, each line's document row, its number in the document)."""
    start = np.unique(np.concatenate([off[:-1], np.flatnonzero(raw == 10) + 1]))
    start = start[start < len(raw)]
    doc = np.searchsorted(off, start, "right") - 1
    w = Words(raw, np.append(start, len(raw)), SPACED_LOWER)
    lead = np.flatnonzero(first_of_runs(doc))
    number = np.arange(len(start)) - np.repeat(lead, np.diff(lead, append=len(start)))
    return w, doc, number


def frequencies(base: DataFrame) -> np.ndarray:
    """How often the words of each cell occur in all lines: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            for lo, hi in groups(off):
                w = Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], SPACED_LOWER)
                total += np.bincount((w.hash % U64(CELLS)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    for r in base.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["cell"]] = r["n"]
    return out


def sets_of_lines(w: Words, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens, rarest first; their lines; offsets by line)."""
    line = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    rarity = np.minimum(freq[(w.hash % U64(CELLS)).astype(np.int64)], (1 << 31) - 1)
    order = np.lexsort((w.hash, rarity, line))
    token, line = w.hash[order], line[order]
    once = first_of_runs(line, token)
    token, line = token[once], line[once]
    return token, line, np.searchsorted(line, np.arange(len(w.first)))


def _announce(freq, num: int, den: int, n_buckets: int):
    def emit(ids: np.ndarray, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        parts: list[list[np.ndarray]] = []
        for lo, hi in groups(off):
            w, row, number = line_words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            token, line, cut = sets_of_lines(w, freq.value)
            size = np.diff(cut)
            some = np.flatnonzero(size)
            if not len(some):
                continue
            value = seeded(token, 31)
            print_ = seeded(np.add.reduceat(value, cut[some]), 32) ^ np.bitwise_xor.reduceat(seeded(token, 33), cut[some])
            bit, word = U64(1) << (value >> U64(58)), value >> U64(56) & U64(3)
            bits = np.bitwise_xor.reduceat(bit, cut[some])
            n = size[some]
            again = np.bitwise_xor.reduceat(U64(1) << (seeded(token, 37) >> U64(58)), cut[some])
            wide = [np.where(n > WIDE, np.bitwise_xor.reduceat(np.where(word == k, bit, U64(0)), cut[some]), again if k == 1 else U64(0)) for k in (1, 2, 3)]
            prefix = n - -(-n * num // den) + 1
            pos = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
            at = np.repeat(cut[some], prefix) + pos
            parts.append([ids[lo:hi][row[some]], number[some], print_, bits, *wide, n, prefix, token[at]])
        if not parts:
            return
        doc, number, print_, bits, *wide, n, prefix, token = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((number, doc, print_))
        lead = order[first_of_runs(print_[order])]
        late = np.setdiff1d(order, lead)
        for piece in np.array_split(late, max(1, len(late) // 200_000)):
            if len(piece):
                yield int(doc[piece[0]] % n_buckets), PASSED, pack(doc[piece], number[piece])
        lead.sort()
        first = np.cumsum(prefix) - prefix
        size = prefix[lead]
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        who = np.repeat(lead, size)
        t = seeded(token[np.repeat(first[lead], size) + pos], 34)
        bucket = t % U64(n_buckets)
        yield from ((b, ENTRY, p) for b, p in pack_rows(bucket, n_buckets, doc[who], (t >> U64(48)).astype(np.uint16), (t >> U64(40)).astype(np.uint8), print_[who].astype(np.uint32), np.where(n[who] > WIDE, 0, print_[who] >> U64(32)).astype(np.uint32), bits[who], *(x[who] for x in wide), number[who], n[who], pos))

    return emit


def _candidates(num: int, den: int):
    """From a bucket of prefix tokens: (kind, doc, line, before_doc, before_line, apart, rest), settled removals and pairs to verify."""

    def run(table: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        near_: list[list[np.ndarray]] = []
        for b in table_rows(table, PASSED):
            doc, line = unpack(b)
            out.append([np.full(len(doc), PASSED, np.int32), doc, line, doc, line, np.zeros(len(doc), np.int64)])
        rows = table_rows(table, ENTRY)
        if rows:
            doc, token, more, low, high, bits, w1, w2, w3, line, n, pos = unpack_rows(rows)
            token = token.astype(np.uint32) << np.uint32(8) | more  # tokens of a bucket that share 24 bits only add candidates
            print_ = np.where(n > WIDE, bits ^ seeded(low.astype(U64), 35) ^ seeded(w1, 36), low.astype(U64) | high.astype(U64) << U64(32))
            line, n, pos = line.astype(np.int64), n.astype(np.int64), pos.astype(np.int64)
            order = np.lexsort((line, doc, print_, n, token))
            doc, token, print_, line, n, pos = (x[order] for x in (doc, token, print_, line, n, pos))
            new = first_of_runs(token, n, print_)
            again = np.flatnonzero(~new & (pos == 0))  # an equal line came before; told once, by its rarest token
            lead = np.flatnonzero(new)
            out.append([np.full(len(again), PASSED, np.int32), doc[again], line[again], doc[again], line[again], np.zeros(len(again), np.int64)])
            doc, token, line, n, pos = (x[lead] for x in (doc, token, line, n, pos))
            bits, w1, w2, w3 = (x[order[lead]] for x in (bits, w1, w2, w3))
            four, second = (w1, w2, w3, bits ^ w1 ^ w2 ^ w3), (w1,)
            # partners follow in the order (token, size): sizes up to n * den / num
            last = np.searchsorted(token.astype(np.float64) * (1 << 21) + np.minimum(n, (1 << 21) - 1), token.astype(np.float64) * (1 << 21) + np.minimum(n * den // num, (1 << 21) - 1), "right")
            # the shorter of two similar lines has a common token in a prefix shorter still
            short = n - -(-n * 2 * num // (num + den)) + 1
            count = np.where(pos < short, np.maximum(last - np.arange(len(n)) - 1, 0), 0)
            total = np.cumsum(count)
            a = 0
            while a < len(n):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
                c = count[a:b]
                i = np.repeat(np.arange(a, b), c)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
                both = n[i] + n[j]
                apart = np.bitwise_count(bits[i] ^ bits[j])
                near = apart <= both * (den - num) // (den + num)
                i, j, both, apart = i[near], j[near], both[near], apart[near]
                apart = apart.astype(np.int64)
                long = (n[i] > WIDE, n[j] > WIDE)
                for both_of, words in ((long[0] & long[1], four), (~long[0] & ~long[1], second)):
                    x, y = i[both_of], j[both_of]
                    apart[both_of] = np.maximum(apart[both_of], sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in words))
                near = apart <= both * (den - num) // (den + num)
                i, j, both, apart = i[near], j[near], both[near], apart[near]
                most = np.minimum(pos[i], pos[j]) + 1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1
                fits = most * (num + den) >= num * both
                i, j, apart = i[fits], j[fits], apart[fits]
                swap = (doc[j] < doc[i]) | ((doc[j] == doc[i]) & (line[j] < line[i]))
                first, later = np.where(swap, j, i), np.where(swap, i, j)
                near_.append([doc[later], line[later], doc[first], line[first], apart])
                a = b
        rest: list[bytes | None] = [None] * sum(len(c[0]) for c in out)
        if near_:
            d, k, fd, fk, apart = (np.concatenate(c) for c in zip(*near_, strict=True))
            order = np.lexsort((fk, fd, apart, k, d))
            d, k, fd, fk, apart = (c[order] for c in (d, k, fd, fk, apart))
            lead = np.flatnonzero(first_of_runs(d, k))
            out.append([np.full(len(lead), ENTRY, np.int32), d[lead], k[lead], fd[lead], fk[lead], apart[lead]])
            rest += [pack(fd[x + 1 : y], fk[x + 1 : y]) if y > x + 1 else None for x, y in zip(lead.tolist(), np.append(lead[1:], len(d))[: len(lead)].tolist(), strict=True)]
        cols = [np.concatenate(c).astype(np.int32 if k == 0 else np.int64) for k, c in enumerate(zip(*out, strict=True))] if out else [np.zeros(0, np.int32 if k == 0 else np.int64) for k in range(6)]
        return pa.table(dict(zip(("kind", "doc", "line", "before_doc", "before_line", "apart"), cols, strict=True)) | {"rest": pa.array(rest, pa.binary())})

    return run


def _cell(doc, line):
    """The bit of a line in the table of wanted lines; the same on columns and on arrays of integers, and without overflow."""
    return ((doc % LINE_BITS + LINE_BITS) * 40503 + (line % LINE_BITS) * 64007) % LINE_BITS


def _marked(table: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return table[cell >> 6] >> (cell & 63) & 1 > 0


def _mask(df: DataFrame, cell) -> np.ndarray:
    """The table of LINE_BITS bits in which the cells of df's rows are set."""
    at = df.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("bits")).toArrow()  # at most LINE_BITS / 64 rows
    table = np.zeros(LINE_BITS // 64, np.int64)
    table[at.column("word").to_numpy()] = at.column("bits").to_numpy()
    return table


def _pick_lines(mask):
    """The token sets of the lines whose bit is set: all wanted ones, and some others.  Documents without any are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_docs, of_lines = mask.value
        for batch in batches:
            batch = batch.filter(pa.array(_marked(of_docs, _cell(batch.column("doc_id").to_numpy(zero_copy_only=False), 0)), pa.bool_()))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            raw, off = buffers(batch.column("text"))
            for lo, hi in groups(off):
                w, row, number = line_words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                doc, words = ids[lo:hi][row], np.diff(w.first)
                at = np.flatnonzero(_marked(of_lines, _cell(doc, number)) & (words > 0))
                if not len(at):
                    continue
                line, token = np.repeat(np.arange(len(at)), words[at]), w.hash[ragged(at, w.first)]
                order = np.lexsort((token, line))
                token, line = token[order], line[order]
                once = first_of_runs(line, token)
                token, line = token[once], line[once]
                cut = np.searchsorted(line, np.arange(len(at) + 1)).astype(np.int32) * 8
                sets = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(token))])
                yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(number[at]), sets], ["d", "l", "tokens"])

    return run


def removed_lines(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line): every line that is similar, num / den or more, to one before it."""
    base = keyed(docs, id_col, text_col)
    n = bucket_count(base, 4 << 20)
    freq = docs.sparkSession.sparkContext.broadcast(frequencies(base))
    found = scatter(base, _announce(freq, num, den, n), n).groupBy("bucket").applyInArrow(_candidates(num, den), "kind int, doc long, line long, before_doc long, before_line long, apart long, rest binary")
    found = staged(found, "line-pairs")
    settled = found.filter(F.col("kind") == PASSED).select("doc", "line")
    entries = found.filter(F.col("kind") == ENTRY)
    # first each line against its nearest candidate; only lines that this leaves open against all others
    nearest = staged(entries.groupBy("doc", "line").agg(F.min(F.struct("apart", "before_doc", "before_line")).alias("b")).select("doc", "line", "b.before_doc", "b.before_line"), "lines-nearest")
    first = staged(_similar(nearest, base, num, den).distinct(), "lines-first")
    still = nearest.join(first, ["doc", "line"], "left_anti").select("doc", "line", F.col("before_doc").alias("near_doc"), F.col("before_line").alias("near_line"))
    others = staged(entries.join(still, ["doc", "line"]).select("doc", "line", "before_doc", "before_line", "rest", "near_doc", "near_line").mapInArrow(_others, "doc long, line long, before_doc long, before_line long").distinct(), "lines-open")
    out = settled.union(first)
    if not others.isEmpty():
        out = out.union(_similar(others, base, num, den))
    return out.distinct()


def _others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of open lines but for the one that was verified."""
    names = ("doc", "line", "before_doc", "before_line", "rest", "near_doc", "near_line")
    for batch in batches:
        for doc, line, before, number, b, near, near_line in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            more = unpack(b) if b else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            before, number = np.append(more[0], before).astype(np.int64), np.append(more[1], number).astype(np.int64)
            new = (before != near) | (number != near_line)
            if new.any():
                k = int(new.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, doc)), pa.array(np.full(k, line)), pa.array(before[new]), pa.array(number[new])], ["doc", "line", "before_doc", "before_line"])


def _similar(pairs: DataFrame, base: DataFrame, num: int, den: int) -> DataFrame:
    """(doc, line) of the pairs whose lines' word sets are similar."""
    # Tables of LINE_BITS bits leave most lines without candidates where they are.
    wanted = pairs.select("doc", "line").union(pairs.select("before_doc", "before_line"))
    mask = pairs.sparkSession.sparkContext.broadcast((_mask(wanted, _cell(F.col("doc"), F.lit(0).cast("long"))), _mask(wanted, _cell(F.col("doc"), F.col("line")))))
    tokens = staged(base.mapInArrow(_pick_lines(mask), "d long, l long, tokens binary"), "line-tokens")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                yes.append(both * den >= num * (len(x) + len(y) - both))
            yield batch.select(["doc", "line"]).filter(pa.array(yes, pa.bool_()))

    x = tokens.select(F.col("d").alias("doc"), F.col("l").alias("line"), F.col("tokens").alias("x"))
    y = tokens.select(F.col("d").alias("before_doc"), F.col("l").alias("before_line"), F.col("tokens").alias("y"))
    similar = pairs.join(x.hint("merge"), ["doc", "line"]).join(y.hint("merge"), ["before_doc", "before_line"]).select("doc", "line", "x", "y").mapInArrow(verify, "doc long, line long")
    return similar


def _cut(text: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts without the lines of these numbers, in time that grows with their lengths."""
    out = []
    for t, numbers in zip(text.to_pylist(), gone.to_pylist(), strict=True):
        if t is not None:
            drop = set(numbers)
            t = "\n".join([x for i, x in enumerate(t.split("\n")) if i not in drop])
        out.append(t)
    return pa.array(out, pa.string())


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str | None = None, **kw) -> DataFrame:
    """docs with the repeated lines taken out of their texts; lines_col, if named, holds the removed line numbers."""
    with Scratch(docs.sparkSession) as scratch:
        key, rows = id_col, docs
        if ids_shared(docs, id_col):
            key, rows = "__row", scratch.keep(numbered(docs, id_col, text_col))
        found = removed_lines(rows, id_col=key, text_col=text_col, **kw)
        gone = scratch.keep(staged(found.groupBy(F.col("doc").alias("__gone_id")).agg(F.sort_array(F.collect_list("line")).alias("__gone")), "lines-removed"))
    out = rows.join(gone.hint("merge"), F.col(key) == F.col("__gone_id"), "left")
    touched = F.when(F.col("__gone").isNotNull(), F.col(text_col))  # only these texts go to Python
    out = out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.arrow_udf(_cut, "string")(touched, F.col("__gone"))))
    if lines_col:
        out = out.withColumn(lines_col, F.coalesce("__gone", F.expr("cast(array() as array<bigint>)")))
    return out.select(*docs.columns, *([lines_col] if lines_col else []))


def digest(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_lines, n_removed, the removed line numbers and kept_sha256 of what is left of the text (null: empty)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = base.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long"))
    out = without_repeats(counted, lines_col="removed", **kw)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.col("removed").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
