import hashlib
import random
import re

from pyspark.sql import functions as F

from glossaflow.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for order, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def texts():
    rng = random.Random(1)
    pieces = ["a.b@c.de", "x@y", "@", "_q%1@m-1.co.uk.", "1.2.3.4", "300.1.1.1", "01.002.0255.9", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+1 (743) 555-3824", "+12", "+49 30 1234567890", "+", "é", "😀", " ", "\n", "  ", "-", ".", "12", "7", "word", "(", ")"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    made += ["".join(rng.choice("ab1@.-+ 0") for _ in range(rng.randrange(40))) for _ in range(1500)]
    made += [None, "", "1" * 30_000, "1 " * 20_000, "a" * 20_000 + "@", "+1" + "(" * 10_000, "x@y.zz " * 3_000, "a@b." * 5_000, "é" * 50 + "4111111111111111", "a@b.c_d@e.f"]
    return made


def test_base_spans_match_python(spark):
    docs = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, pii_base string").repartition(4)
    rows = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert len(rows) == len(docs)
    for i, t in enumerate(docs):
        got = [(s["kind"], s["start"], s["end"]) for s in rows[i]["pii"] if s["base"]]
        assert got == brute(t), (t or "")[:200]
        assert rows[i]["pii_base"] == "x"
        assert rows[i]["pii"] == sorted(rows[i]["pii"], key=lambda s: (s["start"], pii.KINDS.index(s["kind"]), s["end"]))


def test_wide_spans(spark):
    # the trees judge sentences that they were not fitted on
    made = pii.examples(77, 600)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id int, text string")
    hit = {r["doc_id"]: any(not s["base"] for s in r["pii"]) for r in pii.find(df).collect()}
    right = sum(hit[i] for i, (_, y) in enumerate(made) if y)
    wrong = sum(hit[i] for i, (_, y) in enumerate(made) if not y)
    assert right / (right + wrong) >= 0.95
    assert right / sum(y for _, y in made) >= 0.6
    plain = ["the year 2020 2021 2022 was", "meet me at noon at the dot com bubble", "on 2024-01-15 we had 12 000 000 visits", "see 10.1.2 and 3.4"]
    df = spark.createDataFrame([(t,) for t in plain], "text string")
    assert all(r["pii"] == [] for r in pii.find(df).collect())


def test_redact_and_listing(spark):
    df = spark.createDataFrame([(1, "é a@b.cc, 1.2.3.4!", "k"), (2, None, "k"), (3, "", "k"), (4, "+1 743 555 3824; 4111111111111111 x", None)], "doc_id long, text string, pii string")
    out = pii.redact(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[1] == "é [EMAIL], [IP]!" and got[2] is None and got[3] == ""
    assert "743" not in got[4] and "4111" not in got[4] and got[4].endswith(" x")
    listed = pii.find(df, out="s").select(pii.listed(F.col("s")).alias("l"), F.sha2(pii.listed(F.col("s")), 256).alias("h")).first()
    assert listed["l"] == "email:2:8,ip:10:17"
    assert listed["h"] == hashlib.sha256(listed["l"].encode()).hexdigest()


def test_plan_is_native_and_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(df).count() == 0
    plan = pii.find(spark.range(3).select("id", F.lit("a@b.cc").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
