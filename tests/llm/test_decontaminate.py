import random

from brute import contamination as brute

from tidemark.llm.decontaminate import contamination, digest, drop_documents, remove_spans


def frames(spark, docs, bench):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")


def cases():
    rnd = random.Random(3)
    bench = [(i, " ".join(rnd.choice("Ab cD éf 9x zz".split()) for _ in range(rnd.randint(1, 14)))) for i in range(12)] + [(90, None), (91, "?!"), (92, "averyveryverylongwordindeed, no")]
    docs = []
    for d in range(80):
        parts = [rnd.choice(bench)[1] or "" if rnd.random() < 0.3 else " ".join(rnd.choice("q w e r t".split()) for _ in range(9)) for _ in range(rnd.randint(0, 6))]
        docs.append((d * 3 - 9, "; ".join(parts).upper() if d % 5 else " - ".join(parts)))
    return docs + [(1000, None), (1001, ""), (1002, "Averyveryverylongwordindeed\nNO")], bench


def test_matches_brute_force_in_one_and_in_many_blocks(spark):
    docs, bench = cases()
    d, b = frames(spark, docs, bench)
    want = brute(docs, bench)
    assert sorted(map(tuple, digest(contamination(d, b)).collect())) == want
    assert sorted(map(tuple, digest(contamination(d, b, max_bytes=200)).collect())) == want


def test_empty_tables_and_repeated_rows(spark):
    d, b = frames(spark, [(1, "a b"), (1, "a b")], [])
    assert [r["n_hit"] for r in digest(contamination(d, b)).collect()] == [0, 0]
    assert digest(contamination(*frames(spark, [], [(1, "x")]))).collect() == []


def test_removal_keeps_clean_documents_and_columns(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"Start. {item.upper()}! End.", "s"), (2, "clean text", "items"), (3, None, None), (None, item, "x")], "doc_id long, text string, spans string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in drop_documents(docs, bench).collect()) == [2, 3]
    out = {r["doc_id"]: r["text"] for r in remove_spans(docs, bench).collect()}
    assert out == {1: "Start. ! End.", 2: "clean text", 3: None, None: ""}
    assert remove_spans(docs, bench).columns == docs.columns


def test_shared_and_missing_ids_keep_their_rows_in_one_and_in_many_blocks(spark):
    docs = [(1, "one two three four"), (1, "five six seven eight"), (2, "a b"), (None, "one two"), (None, "clean"), (None, None)]
    d, b = frames(spark, docs, [(7, "one two"), (8, "b")])
    want = [(1, 4, 2, 1), (1, 4, 0, 0), (2, 2, 1, 1), (None, 2, 2, 1), (None, 1, 0, 0), (None, 0, 0, 0)]
    for most in (1 << 20, 8, 1):
        got = [tuple(r)[:4] for r in digest(contamination(d, b, max_bytes=most)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert sorted((r["text"] for r in remove_spans(d, b, max_bytes=most).collect()), key=str) == sorted([" three four", "five six seven eight", "a ", "", "clean", None], key=str)
        assert sorted((tuple(r) for r in drop_documents(d, b, max_bytes=most).collect()), key=str) == sorted([(1, "five six seven eight"), (None, "clean"), (None, None)], key=str)


def test_a_megabyte_of_text(spark):
    item = " ".join(f"w{i}" for i in range(10))
    docs = [(1, "x y z " * 170_000 + item), (2, "a" * 1_000_000)]
    d, b = frames(spark, docs, [(5, item)])
    assert sorted(tuple(r)[1:4] for r in digest(contamination(d, b)).collect()) == [(1, 0, 0), (510_010, 10, 1)]
