import random

import numpy as np
from brute import SPACED, sha
from brute import repeated_spans as brute

from tidemark.llm.substring import parse, repeated_spans
from tidemark.llm.textcore import seeded


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r)[:4] for r in repeated_spans(df, **kw).collect())


def test_random_texts_with_shared_passages(spark):
    rnd = random.Random(5)
    passages = [[rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(15, 60))] for _ in range(12)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rnd.randint(0, 6)):
            words += rnd.choice(passages) if rnd.random() < 0.5 else [str(rnd.randint(0, 30)) for _ in range(rnd.randint(1, 30))]
        rows.append((d * 7, " \n".join(words)))
    assert run(spark, rows) == brute(rows)


def test_runs_short_null_and_unicode(spark):
    rows = [(1, "a " * 70), (2, "a " * 30 + "b " + "a " * 25), (3, None), (4, ""), (5, "x y"), (6, "ü é " * 45), (7, "A " * 25 + "\x00 q"), (9, "w" * 50_000 + " z" * 19)]
    assert run(spark, rows) == brute(rows)


def test_rows_sharing_an_id_and_empty_table(spark):
    text = " ".join(map(str, range(30)))
    assert [r[2] for r in run(spark, [(1, text), (1, text), (2, text)])] == [0, 0, 30]
    assert run(spark, []) == []


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 3, 4)], "doc_id long, text string, bucket int, payload int")
    assert repeated_spans(df).first()["n_words"] == 2


def test_rows_of_one_id_or_none_are_judged_by_their_own_words(spark):
    a, b = " ".join(map(str, range(40))), " ".join(f"w{i}" for i in range(40))
    rows = [(1, a), (2, "x " + a), (2, "x " + b), (3, b), (None, a), (None, "q"), (None, None)]
    got = sorted((tuple(r)[:3] for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 40, 0), (2, 41, 40), (2, 41, 0), (3, 40, 40), (None, 40, 0), (None, 1, 0), (None, 0, 0)], key=str)


def test_runs_are_named_once_and_interiors_agree():
    rnd = random.Random(2)
    for _ in range(200):
        middle = [x for _ in range(8) for x in [rnd.choice("abc")] * rnd.choice([1, 1, 1, 5, 30])]
        places = []
        for _ in range(2):
            head, tail = ([rnd.choice("abc") for _ in range(rnd.randint(0, 30))] for _ in range(2))
            h = seeded(np.array([ord(c) for c in head + middle + tail], np.uint64), 1)
            name, start, begin, end = parse(h, np.array([0, len(h)]), True)
            x, y = begin[len(head)], end[len(head) + len(middle)]
            inner = (start >= x) & (start < y)
            assert not inner.any() or (start[inner][0] == x and y in {*start.tolist(), len(h)})
            places.append([(int(n), int(s) - len(head)) for n, s in zip(name[inner], start[inner])])
        assert places[0] == places[1]
    name, start = parse(seeded(np.zeros(1000, np.uint64), 1), np.array([0, 1000]))
    assert len(name) == 1


def test_colliding_window_hashes_change_nothing(spark):
    rnd = random.Random(9)
    passage = [str(rnd.randint(0, 50)) for _ in range(45)]
    rows = [(d, " ".join([str(rnd.randint(0, 9)) * 2 for _ in range(30)] + passage * (d % 2) + ["a"] * rnd.randint(0, 40))) for d in range(12)]
    assert run(spark, rows, hash_bits=1) == brute(rows)


def test_a_megabyte_of_text(spark):
    text = "a b c d e " * 100_000
    (row,) = run(spark, [(1, text)])
    assert row[1:3] == (500_000, 500_000 - 5) and row[3] == sha(" ".join(SPACED.findall(text)[:5]))
