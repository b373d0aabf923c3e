import random
import re

from brute import sha

from tidemark.llm.secrets import BASE, RULES, digest, scan, trigram_query, trigrams

KEY = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(t):
    out = [("assign", 0, m) for m in KEY.finditer(t) if len(m[2]) >= 8]
    out += [("access", 1, m) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", 2, m) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    out.sort(key=lambda x: (x[2].start(), x[1]))
    n = [sum(k == kind for k, _, _ in out) for kind in ("assign", "access", "hex")]
    return (*n, sha(",".join(f"{k}:{m.start()}:{m.end()}" for k, _, m in out)))


def test_base_spans_match_plain_regexes(spark):
    rnd = random.Random(1)
    bits = ["password", "PassWD", "secret ", "token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abcdefgh", "x9/+", "AKIA", "AKIAABCDEFGH1234", "0af3" * 9, "é𝄞", "\n", "deadbeef", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "ſecret=abcdefghij", "toKen: abcdefghijk"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))) for i in range(400)] + [(900, None), (901, ""), (901, "token=abcdefgh"), (None, "secret: 123456789")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", __import__("pyspark").sql.functions.lit(1)).withColumn("kinds", __import__("pyspark").sql.functions.lit(1))
    got = sorted((tuple(r)[:5] for r in digest(scan(df)).collect()), key=str)
    assert got == sorted(((d, *base(t or "")) for d, t in rows), key=str)


def test_method_adds_spans(spark):
    df = spark.createDataFrame([(1, "x ghp_" + "z" * 36 + " token=abcdefgh")], "doc_id long, text string")
    assert digest(scan(df)).first()["spans"] == "github:2:42,assign:43:57"
    assert digest(scan(df.limit(0))).collect() == []


def test_queries_hold_for_every_match():
    assert trigram_query("[0-9a-f]{32,}") is True
    assert trigrams(trigram_query("AKIA[A-Z0-9]{12,}")) == {"aki", "kia"}
    assert {"pas", "tok", "api"} <= trigrams(trigram_query(BASE[0].pattern))
    assert all(trigram_query(r.pattern) is not True for r in RULES if r.kind != "hex")


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh")], "doc_id long, text string")
    plan = digest(scan(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_worst_cases_of_a_megabyte_take_linear_time(spark):
    n = 1_000_000
    rows = [
        (1, "x://y " + "z" * n), (2, "eyJ" * (n // 3)), (3, "eyJ" * (n // 3) + "." + "eyJ" * 9 + ".x"), (4, "password" + " " * n), (5, "AKIA" * (n // 4)), (6, "deadbee " * (n // 8)),
        (7, "-----BEGIN " + "A " * (n // 2)), (8, "ghp_" * (n // 4)), (9, "a://" * (n // 4)), (10, "token=abcdefgh " * 60_000),
    ]
    out = {r["doc_id"]: r for r in digest(scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))).collect()}
    assert out[3]["spans"] == f"jwt:0:{n // 3 * 3 + 30}"
    assert out[5]["n_access"] == 1 and out[10]["n_assign"] == 60_000
    assert out[10]["spans"].endswith(f",assign:{59_999 * 15}:{59_999 * 15 + 14}")
    assert all(out[i]["spans"] == "" for i in (1, 2, 4, 6, 7, 8, 9))


def test_patterns_that_try_a_run_once_match_the_same(spark):
    rnd = random.Random(5)
    bits = ["eyJ", "abcdefghij", ".", "x", "-", " ", "://", ":", "@", "user", "é", "A", "/"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))) for i in range(3000)] + [(9000, "zeyJabcdefgh.eyJabcdefgh.q.eyJabcdefgh.eyJ12345678.w http://u:p@h a1://u:p@x://u:q@")]
    want = {}
    for i, t in rows:
        want[i] = sorted((m.start(), f"{r.kind}:{m.start()}:{m.end()}") for r in RULES if r.once for m in re.finditer(r.pattern, t))
    got = {r["doc_id"]: [x for x in r["spans"].split(",") if x.split(":")[0] in ("jwt", "url_password")] for r in digest(scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {i: [x for _, x in w] for i, w in want.items()} and sum(map(len, want.values())) > 20
