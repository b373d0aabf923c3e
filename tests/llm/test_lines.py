import random

from brute import SPACED, lower, sha

from tidemark.llm.lines import digest, without_repeats


def brute(docs, num=80, den=100):
    seen, out = [], []
    for d, t in sorted(docs, key=lambda x: x[0]):
        gone, lines = [], [] if t is None else t.split("\n")
        for i, line in enumerate(lines):
            s = set(SPACED.findall(lower(line)))
            if s and any(den * len(s & o) >= num * len(s | o) for o in seen):
                gone.append(i)
            if s:
                seen.append(s)
        out.append((d, len(lines), len(gone), gone, sha("\n".join(x for i, x in enumerate(lines) if i not in gone))))
    return out


def test_matches_brute_force(spark):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(400)] + ["É", "the"] * 20
    pool = [[rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 4, 9, 20, 45]))] for _ in range(80)]
    docs = []
    for d in range(90):
        lines = []
        for _ in range(rnd.randint(0, 7)):
            w = list(rnd.choice(pool)) if rnd.random() < 0.7 else [rnd.choice(vocab) for _ in range(rnd.randint(0, 12))]
            for _ in range(rnd.choice([0, 0, 0, 1, 2, 5])):
                w[rnd.randrange(len(w) + 1) :][:1] = []
                w.insert(rnd.randrange(len(w) + 1), rnd.choice(vocab))
            lines.append(" ".join(w).upper() if rnd.random() < 0.2 else " ".join(w))
        docs.append((d * 3, "\n".join(lines)))
    docs += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "a\n"), (1004, "x " * 30_000 + "\n" + "x"), (1005, "\r\n the END \n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, digest(df).collect())) == brute(docs)


def test_columns_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c\nd", 1), (2, "D\nA b C\nnew", 2), (None, "d", 3)], "doc_id long, text string, line int")
    out = without_repeats(df)
    assert out.columns == df.columns
    assert {r["line"]: r["text"] for r in out.collect()} == {1: "a b c\nd", 2: "new", 3: "d"}
    assert digest(df.limit(0)).collect() == []


def test_rows_of_one_id_are_judged_apart_and_many_lines_take_linear_time(spark):
    df = spark.createDataFrame([(3, "a b c\nd e f"), (3, "x y z\nd e f"), (2, "x y z")], "doc_id long, text string")
    assert sorted(tuple(r) for r in without_repeats(df).collect()) == [(2, "x y z"), (3, ""), (3, "a b c\nd e f")]
    text = "\n".join(f"line {i // 2} w{i // 2}" for i in range(60_000))
    row = digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_lines"] == 60_000 and row["n_removed"] == 30_000
