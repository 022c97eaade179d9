import random
import re

import pytest
from pyspark.sql import functions as F

from glossaflow.functions import text as T
from glossaflow.operators import annotate


def one(spark, *rows, **cols):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [list(r)[1:] for r in df.select("i", *[c.alias(n) for n, c in cols.items()]).orderBy("i").collect()]


def test_sanitize(spark):
    texts = ["a [b] c", "a­b", "a b", "x​y‮z", "1 + 2 = 3 😀", "a  \n b", "a , b", "...", "12:30", "Что?!", "", "  hi  ", "[open", "é"]
    want = ["a c", "ab", "a b", "xyz", "1 2 3", "a b", "a, b", ". ..", "12: 30", "Что? !", "", "hi", "[open", "e"]
    assert [r[0] for r in one(spark, *texts, s=T.sanitize(F.col("s")))] == want


def test_validity(spark):
    rows = one(spark, "abcd", "++++a", "++++", "", v=T.validity(T.sanitize(F.col("s")), F.col("s")))
    assert [r[0] for r in rows] == ["ok", "shrunk", "empty", "empty"]


# the pattern as documented, with backtracking; the engine uses a linear rewrite
ORIGINAL = re.compile(r'([^.!?…]*(?:[.!?](?:[.]*|…)?[»"]*|…|[^.!?…]+»))\s*')


def brute_sentences(s):
    out, last = [], 0
    if not s.strip():
        return out
    for m in ORIGINAL.finditer(s):
        t = m[1].strip(" ")
        if t:
            out.append(t)
            last = m.end()
    tail = s[last:].strip(" ")
    return out + ([tail] if tail else [])


def test_sentences_against_the_original_pattern(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice('аб .!?…»«" ') for _ in range(rng.randrange(25))).strip() for _ in range(3000)]
    texts = [re.sub(" +", " ", t) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").repartition(4)
    df = df.select("i", T.sentence_heads(F.col("s")).alias("h"), T.sentence_tail(F.col("s")).alias("t")).select("i", T.join_sentences(F.col("h"), F.col("t")).alias("x"))
    got = {r["i"]: r["x"] for r in df.collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_sentences(t), t


def test_other_splits(spark):
    rows = one(spark, "Да! Нет… т.е. так", "", "a. b.c", scan=T.sentences_scan(F.col("s")), dots=T.sentences_dots(F.col("s")))
    assert rows[0][0] == ["Да!", "Нет… т.", "е.", "так"]
    assert rows[1] == [[], []]
    assert rows[2][1] == ["a.", "b.", "c."]


def brute_units(s):
    """Character by character: words with inner hyphens, ellipses, marks."""
    marks, out, i = set(',.!?;:()*—–«»…“„"-'), [], 0
    letter = lambda k: k < len(s) and s[k] not in marks and s[k] not in "\t\n\v\f\r "
    while i < len(s):
        if letter(i):
            j = i
            while letter(j) or (j < len(s) and s[j] in "-–—" and letter(j + 1)):
                j += 1
            out.append((i, s[i:j]))
            i = j
        elif s.startswith("...", i):
            out.append((i, "..."))
            i += 3
        else:
            if s[i] in marks:
                out.append((i, s[i]))
            i += 1
    return out


def test_units_and_places(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice('aбв-–—. ,…«»"\n') for _ in range(rng.randrange(20))) for _ in range(1500)] + ["кто-то — «я»...", "a-" * 20_000 + "b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, sentence string").repartition(4)
    got = {}
    for r in annotate.units(df).orderBy("i", "unit_no").collect():
        got.setdefault(r["i"], []).append((r["start_c"], r["unit"]))
        t = texts[r["i"]]
        assert t[r["start_c"] : r["end_c"]] == r["unit"] and t.encode()[r["start_b"] : r["end_b"]].decode() == r["unit"]
    for i, t in enumerate(texts):
        assert got.get(i, []) == brute_units(t)


@pytest.mark.parametrize(
    ("text", "needle", "want"),
    [("Привет мир", "мир", "Привет <mark>мир</mark>"), ("JavaScript", "javascript", "<mark>JavaScript</mark>"), ("кот кот", "КОТ", "<mark>кот</mark> <mark>кот</mark>"), ("abc", "", "abc"), ("", "a", ""), ("abc", "x", "abc"), ("c++ [x]", "c++", "<mark>c++</mark> [x]")],
)
def test_highlight(spark, text, needle, want):
    assert one(spark, text, s=T.highlight(F.col("s"), needle)) == [[want]]


def test_strings(spark):
    s = F.col("s")
    got = one(spark, "Привет, мир", "", a=T.char_at(s, 1), b=T.slice_inclusive(s, 0, 2), c=T.find(s, "р"), d=T.find(s, "р", 2), e=T.find(s, ""), f=T.char_offsets(s), g=T.byte_to_char(s, 4))
    assert got[0] == ["р", "При", 1, 10, 0, [0, 2, 4, 6, 8, 10, 12, 13, 14, 16, 18], 2]
    assert got[1] == ["", "", -1, -1, 0, [], 0]
    assert one(spark, "ПРИВЕТ World ЁІЄ", s=T.cyrillic_lower(s)) == [["привет World ёіє"]]
    assert one(spark, 'a "b"', s=T.escape_quotes(s)) == [["a &quot;b&quot;"]]
    assert one(spark, "x" * 91, " y ", s=T.snippet(s)) == [["x" * 90 + "..."], ["y"]]
    assert one(spark, "B-SUBJECT", "I-X-Y", "O", a=T.base_label(s), b=T.metric_class(s)) == [["SUBJECT", "SUBJECT"], ["X-Y", "X"], ["O", "O"]]
    assert one(spark, "B-ADDITION", "O", "Z", a=T.type_name(s), b=T.role(T.type_name(s))) == [["дополнение", "доп."], ["другое", "др."], ["Z", "Z"]]


def test_running_values(spark):
    from glossaflow.functions.arrays import running

    rng = random.Random(12)
    rows = [(n, [rng.randrange(9) for _ in range(n)]) for n in (0, 1, 2, 31, 32, 33, 1000, 20_000)]
    df = spark.createDataFrame(rows, "n int, v array<long>")
    got = df.select("n", running(F.col("v")).alias("s"), running(F.col("v"), lambda a, b: F.greatest(a, b), 3).alias("m")).collect()
    for (n, v), r in zip(rows, sorted(got, key=lambda r: r["n"])):
        total, most, sums, tops = 0, 3, [], []
        for x in v:
            sums.append(total)
            tops.append(most)
            total, most = total + x, max(most, x)
        assert (r["n"], r["s"], r["m"]) == (n, sums, tops)
