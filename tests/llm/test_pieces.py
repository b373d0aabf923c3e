import random

import pyarrow as pa
import pytest
import sentencepiece

from tidemark.llm.pieces import MODEL, DoubleArray, Pieces, Segments, decode, decoded, encode, encoded, terminal_counts, token_counts
from tidemark.llm.textcore import buffers


def as_unigram(data: bytes) -> bytes:
    """The model file with its model type set to unigram, so that the installed library runs Viterbi over the same scores."""
    out = bytearray(data)

    def varint(i):
        r = s = 0
        while True:
            b = out[i]
            r |= (b & 127) << s
            s, i = s + 7, i + 1
            if b < 128:
                return r, i

    i = 0
    while i < len(out):
        tag, i = varint(i)
        n, i = varint(i)
        j = i if tag == 0x12 else len(out)  # the trainer's settings
        while j < i + n:
            t, j = varint(j)
            if t & 7 == 0:
                at = j
                _, j = varint(j)
                if t >> 3 == 3:
                    out[at] = 1
                    return bytes(out)
            else:
                m, j = varint(j) if t & 7 == 2 else ({1: 8, 5: 4}[t & 7], j)
                j += m
        i += n
    raise ValueError("no model type")


@pytest.fixture(scope="module")
def pieces():
    return Pieces()


def texts():
    rnd = random.Random(1)
    signs = "abc de fé\n日𝄞 ▁.,the and tion  0"
    out = ["", "a", " ", "  hello  world", "x\ny\n\n z\t", "Ouè éaux. Çan", "𝄞𝄞 𝄞a", "日本語", "a▁b", "   ", "\n", "1234567890" * 5, "é" * 30, "\x00\x01", "-----====="]
    return out + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(500)]


def test_same_as_the_library_and_round_trip(pieces):
    sp = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(open(MODEL, "rb").read()))
    t = texts()
    ids, cut = encode(pieces, *buffers(pa.array(t, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [sp.encode(x) for x in t]
    assert [d.decode() for d in decode(pieces, ids, cut)] == [x.replace("▁", " ") for x in t]


def test_trie_counts_equal_encoding(pieces):
    col = buffers(pa.array(texts(), pa.string()))
    seg = Segments(*col, pieces.alone)
    counts = terminal_counts(pieces, seg)[seg.of]
    _, cut = encode(pieces, *col)
    assert [int(counts[a:b].sum()) for a, b in zip(seg.first[:-1], seg.first[1:], strict=True)] == (cut[1:] - cut[:-1]).tolist()


def test_double_array_finds_all_and_only_its_strings():
    import numpy as np

    rnd = random.Random(4)
    strings = sorted({bytes(rnd.randint(0, 255) for _ in range(rnd.randint(1, 5))) for _ in range(900)})
    t = DoubleArray(strings)

    def find(s):
        state = np.zeros(1, np.int32)
        for b in s:
            state, ok = t.step(state, np.array([b], np.uint8))
            if not ok[0]:
                return -1
        return int(t.value[state[0]])

    assert [find(s) for s in strings] == list(range(len(strings)))
    assert find(strings[5] + b"zzz") == -1


def test_dataframes(spark):
    df = spark.createDataFrame([(1, "hello é 𝄞", 1), (1, "hello é 𝄞", 2), (2, None, 3), (None, "", 4)], "doc_id long, text string, ids int")
    out = {r["doc_id"]: r for r in encoded(df).collect()}
    assert out[1]["round_trip"] and out[1]["n_pieces"] == len(out[1]["ids"])
    assert out[2]["ids"] is None and out[2]["n_pieces"] == 0 and out[None]["ids"] == []
    assert {r["text"] for r in decoded(encoded(df)).collect()} == {"hello é 𝄞", None, ""}
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts(df).collect()) == sorted((k or 0, r["n_pieces"]) for k, r in list(out.items()) + [(1, out[1])])
    assert encoded(df.limit(0)).collect() == [] and token_counts(df.limit(0)).collect() == []


def test_long_segments_equal_the_library_and_take_linear_time(spark, pieces):
    sp = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(open(MODEL, "rb").read()))
    rnd = random.Random(7)
    t = ["".join(rnd.choice("abcdeftheingioné日") for _ in range(n)) for n in (250, 255, 256, 257, 300, 900)] + ["a" * 700, "日" * 400, "x " * 300]
    ids, cut = encode(pieces, *buffers(pa.array(t, pa.string())))
    got = [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    assert [sum(pieces.piece_at[i + 1] - pieces.piece_at[i] for i in x) for x in got] == [len(x.encode()) + 1 for x in t]
    score = {int(i): s for i, s in zip(pieces.ids, pieces.score, strict=True)}
    for a, b in zip(got, map(sp.encode, t), strict=True):  # the library rounds its sums to single precision: compare costs
        assert sum(score.get(i, -1e9) for i in a) >= sum(score.get(i, -1e9) for i in b) - 1e-6
    seg = Segments(*buffers(pa.array(t, pa.string())), pieces.alone)
    assert [terminal_counts(pieces, seg)[seg.of][x:y].sum() for x, y in zip(seg.first[:-1], seg.first[1:], strict=True)] == [len(x) for x in got]
    big = spark.createDataFrame([(1, "".join(rnd.choices("abcdefth", k=1_000_000)))], "doc_id long, text string")
    row = encoded(big).first()
    assert row["round_trip"] and token_counts(big).first()["n_tokens"] == row["n_pieces"]
