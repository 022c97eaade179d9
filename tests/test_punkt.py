import math
import random
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from glossaflow.functions import arrow
from glossaflow.operators import punkt

ANY = "[\x09-\x0d\x1c-\x20\x85\xa0  -     　]"


def words_of(text):
    text = re.sub(" +([.,!?;:])", r"\1", re.sub(ANY + "+", " ", text or "")).strip(" ")
    out = []
    for piece in filter(None, text.split(" ")):
        core = re.sub("""[)\\]"'»”,;:]+$""", "", re.sub("""^[(\\["'«“„]+""", "", piece))
        stem = re.sub("[.!?…]+$", "", core).lower()
        kind = punkt.NUMBER if re.fullmatch(r"[-+]?[0-9][0-9.,:/-]*", stem) else stem
        ending = "hard" if core[-1:] in "!?" and core else "ellipsis" if core.endswith("..") or core.endswith("…") else "stop" if core.endswith(".") else "none"
        case = {"Lu": "upper", "Ll": "lower"}.get(unicodedata.category(core[0]), "none") if core else "none"
        out.append((piece, kind, ending, case))
    return out


def ratio(a, b, ab, n):
    def term(k, m, p):
        return k * math.log(p) + m * math.log(1 - p) if 0 < p < 1 else 0.0

    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a) if n > a else 0.0
    rest = n - a - b + ab
    return -2 * (term(ab, a - ab, p) + term(b - ab, rest, p) - (0 if a == ab else term(ab, a - ab, p1)) - (0 if b == ab else term(b - ab, rest, p2)))


class Plain:
    """The method over lists, token by token."""

    def __init__(self, texts):
        docs = [words_of(t) for t in texts]
        self.stops, self.count = Counter(), Counter()
        for w in (w for d in docs for w in d):
            self.count[w[1]] += 1
            self.stops[w[1]] += w[2] == "stop"
        n = sum(self.count.values())
        p = min(max(sum(self.stops.values()) / n, 1e-9), 1 - 1e-9) if n else 0.5
        self.short = {t for t in self.count if self.score(t, p) >= 0.3}
        self.seen, first, pairs = {}, Counter(), Counter()
        for d in docs:
            last = None
            for w in d:
                place = self.place(last)
                self.seen.setdefault(w[1], set()).add((w[3], place))
                first[w[1]] += place == "first" and last is not None
                if last and last[2] == "stop":
                    pairs[last[1], w[1]] += 1
                last = w
        ends = sum(first.values())
        self.opens = {t for t, k in first.items() if k and re.match(r"[^\W\d_]", t) and n / ends > self.count[t] / k and ratio(ends, self.count[t], k, n) >= 30}
        self.drawn = set()
        for (a, b), k in pairs.items():
            if k > 1 and all(re.search(r"[^\W\d_]|#", t) for t in (a, b)) and (a in self.short or a == punkt.NUMBER or re.fullmatch(r"[^\W\d_]", a)):
                if n / self.count[a] > self.count[b] / k and ratio(self.count[a], self.count[b], k, n) >= 7.88:
                    self.drawn.add((a, b))

    def score(self, t, p):
        k, m = self.stops[t], self.count[t] - self.stops[t]
        if not k or t == punkt.NUMBER or not re.search(r"[^\W\d_]", t):
            return 0.0
        likely = -2 * (k * (math.log(p) - math.log(0.99)) + m * (math.log(1 - p) - math.log(1 - 0.99)))
        dots = t.count(".")
        return likely * math.exp(dots - len(t)) * (dots + 1) * float(len(t) - dots) ** -m

    def place(self, last):
        if last is None or last[2] == "hard":
            return "first"
        if last[2] == "ellipsis":
            return "unknown"
        return "inner" if last[2] == "none" else "unknown" if last[1] in self.short else "first"

    def ends(self, a, b):
        if a[2] == "none":
            return False
        if a[2] == "hard":
            return True
        dots, upper, lower = a[2] == "ellipsis", b[3] == "upper", b[3] == "lower"
        seen = self.seen[b[1]]
        ever = {c for c, _ in seen}
        guess = True if upper and "lower" in ever and ("upper", "inner") not in seen else False if lower and ("upper" in ever or ("lower", "first") not in seen) else None
        initial, number, short = not dots and re.fullmatch(r"[^\W\d_]", a[1]), not dots and a[1] == punkt.NUMBER, dots or a[1] in self.short
        if not dots and (a[1], b[1]) in self.drawn:
            return False
        if short and not initial and (guess or (upper and b[1] in self.opens)):
            return True
        if (initial or number) and guess is False:
            return False
        if initial and guess is None and upper and "lower" not in ever:
            return False
        return not short

    def split(self, text):
        out, held = [], []
        found = words_of(text)
        for a, b in zip(found, [*found[1:], None]):
            held.append(a[0])
            if b is None or self.ends(a, b):
                out.append(" ".join(held))
                held = []
        return out


def corpus(rng):
    names = ["Dr.", "Dr. Smith", "z.B.", "e.g.", "S.", "1.", "12.5", "5.", "Smith", "Jones", "B."]
    plain = "the cat sat on a mat and then he went home with some other people nobody knew why so they left Today it rains".split()
    texts = []
    for _ in range(300):
        words = []
        for _ in range(rng.randrange(0, 40)):
            w = rng.choice(names) if rng.random() < 0.25 else rng.choice(plain)
            if w not in names and rng.random() < 0.2:
                w += rng.choice([".", ".", "!", "?", "...", "…", '."', ".)", ".»", ":", ","])
            if rng.random() < 0.05:
                w = rng.choice("(\"'«") + w
            words.append(w.capitalize() if rng.random() < 0.2 else w)
            if w.endswith(".") and w not in names and rng.random() < 0.6:
                words.append(rng.choice(["However", "Then"]))
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    return texts + ["", None, "...", ". . .", "!", "Dr. Smith came. He left.", "\t\n"]


def test_against_plain(spark):
    texts = corpus(random.Random(6))
    want = Plain(texts)
    assert want.short and want.opens and want.drawn
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    pairs = punkt.neighbours(df)
    kinds = punkt.types(pairs)
    assert {r["type"] for r in kinds.filter("abbreviation").collect()} == want.short
    assert {r["type"]: (r["stops"], r["plain"]) for r in kinds.collect()} == {t: (want.stops[t], n - want.stops[t]) for t, n in want.count.items()}
    assert {r["type"] for r in punkt.starters(punkt.in_context(pairs, kinds)).filter("starter").collect()} == want.opens
    assert {(r["before"], r["type"]) for r in punkt.collocations(pairs, kinds).filter("collocation").collect()} == want.drawn
    joined = punkt.joined_stops(pairs)
    for most in (punkt.MAX_PAIRS, 0):
        got = {}
        for r in punkt.split(df, joined, ["i"], max_pairs=most).orderBy("i", "sent_no").collect():
            got.setdefault(r["i"], []).append(r["sentence"])
        for i, t in enumerate(texts):
            assert got.get(i, []) == want.split(t), t


def test_no_rows_and_long_texts(spark):
    none = spark.createDataFrame([], "i int, text string")
    assert punkt.split(none, punkt.joined_stops(punkt.neighbours(none)), ["i"]).count() == 0
    df = spark.createDataFrame([(1, "word " * 100_000), (2, "A word. " * 20_000)], "i int, text string")
    got = punkt.split(df, punkt.joined_stops(punkt.neighbours(df)), ["i"]).groupBy("i").agg(F.count("*").alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {1: 1, 2: 20_000}


def test_plain_words_take_the_short_way(spark):
    df = spark.createDataFrame([(w,) for w in ("größe", "été", "a", "a÷b", "x.", "Ab", "«ok»", "12")], "w string")
    plan = df.select(punkt.word(F.col("w")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("a-zß-öø-ÿ") >= 0 and "CASE WHEN" in plan
    got = {r["w"]: tuple(r["x"]) for r in df.select("w", punkt.word(F.col("w")).alias("x")).collect()}
    assert got["größe"] == ("größe", "none", "lower") and got["a÷b"] == ("a÷b", "none", "lower")
    assert got["x."] == ("x", "stop", "lower") and got["«ok»"] == ("ok", "none", "lower") and got["12"] == (punkt.NUMBER, "none", "none")


def test_counted_in_one_pass_whatever_is_held(spark, monkeypatch):
    """Words are told apart as word() does, pairs behind words without an ending are one, and what is handed on early adds up to the same."""
    texts = corpus(random.Random(8)) + ["A\x85b \u3000 . c\x1f!", "ÀB. İx Σ", "«(» '1,5.' -2... x?\" ...»"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})

    def counted():
        sums = Counter()
        for b in punkt._count(iter([batch, batch])):
            for r in b.to_pylist():
                sums[tuple(v for k, v in r.items() if k != "n")] += r["n"]
        return sums

    whole = counted()
    monkeypatch.setattr(punkt, "HELD", 20)
    monkeypatch.setattr(arrow, "SLICE", 300)
    assert counted() == whole
    assert {k[3] for k in whole if k[4] == "none"} == {""} and sum(whole.values()) == 2 * sum(len(words_of(t)) for t in texts)
    seen = sorted({p for t in texts for p in punkt.pieces(t or "")})
    rows = spark.createDataFrame([(p,) for p in seen], "p string").select("p", punkt.word(F.col("p")).alias("w")).collect()
    known = punkt.Words()
    numbers = {p: known[p] for p in seen}
    told = [(t, str(punkt._ENDINGS[e]), c) for t, e, c in known.known]
    assert {r["p"]: tuple(r["w"]) for r in rows} == {p: told[n] for p, n in numbers.items()}
