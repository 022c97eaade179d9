"""Personal data by candidate boosting, in DataFrame operations only.

Two kinds of generators propose spans, which may overlap. The base generators are
exact formats (e-mail, ip, card with Luhn check, phone with +); their spans always
stay. The wide generators have a high recall and propose disguised e-mails, ips
with bracketed dots, cards with unusual separators and phones without +. Each wide
candidate gets format and context features, gradient-boosted trees score it, and a
threshold of each kind, calibrated on held-out candidates for precision, selects.

The trees are fitted here, on generated sentences that pass through the very same
feature expressions, and compiled to SQL expressions. Everything happens inside a
row: the plan over the documents is one scan and projections, without a shuffle.
Regexes have possessive loops, so long texts neither overflow nor backtrack.
"""

from __future__ import annotations

import functools
import json
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import blocks, cut, let, running
from .common import free_name, spread

#: Kinds in their order of listing.
KINDS = ("email", "ip", "card", "phone")

# A match starts at the first character of a run, or where the last match ended;
# a later start in the same run fails as the first does.
_LOCAL = r"[A-Za-z0-9._%+-]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT = r"(?: ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| (?:at|AT) )"
_DOT = r"(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) |\.)"
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}+){3}",
    "card": r"(?<![0-9])[0-9]{4}+(?:[./_]|  |- | -)[0-9]{4,6}+(?:[./_]|  |- | -)[0-9]{4,5}+(?:(?:[./_]|  |- | -)[0-9]{1,4}+)?(?![0-9])",
    "phone": r"(?<![0-9+A-Za-z.,/_-])(?:\([0-9]{2,4}\) ?|00 ?[0-9]{1,3}[ .-]|0?[0-9]{2,4}[ .-])(?:[0-9]{2,4}[ .-]){1,4}[0-9]{2,4}(?![0-9A-Za-z@%]|[.,/-][0-9])",
}
_GATE = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"),
    "phone": lambda t: t.contains("+"),
}
_WIDE_GATE = {
    "email": lambda t: t.rlike(r"(?i)[ \[({<](?:at|@)[ \])}>]"),
    "ip": lambda t: t.rlike(r"[0-9](?:\[|\()"),
    "card": lambda t: t.rlike(r"[0-9]{4}[./_ -]"),
    "phone": lambda t: t.rlike(r"[0-9]{2}[) .-][0-9 ]"),
}
_SPAN = "struct<kind:int,start:long,end:long,hit:string,pre:string,post:string>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes; places count from the right."""
    return F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.pmod(d.cast("int") * 2, F.lit(10)) + F.floor(d.cast("int") / 5).cast("int")),
        ),
        F.lit(0),
        lambda a, d: a + F.coalesce(d, F.lit(0)),
    ) % 10 == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, hit: Column) -> Column:
    """What a base match must pass besides its pattern."""
    n = F.length(_digits(hit))
    if kind == "ip":
        return hit.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(hit))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _kept(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda x: _valid(kind, x["hit"]))


def _spans(text: Column, kind: str, pattern: str, gate) -> Column:
    """All leftmost non-overlapping matches in a text, in code points.

    The text is split at the matches; gaps and matches in turn add up to positions.
    """
    code = F.lit(KINDS.index(kind))

    def placed(x: Column) -> Column:
        h, g = x["h"], x["g"]
        sizes = F.zip_with(h, F.slice(g, 1, F.size(h)), lambda a, b: (F.length(a) + F.length(b)).cast("long"))
        zipped = F.arrays_zip(h.alias("h"), F.slice(g, 1, F.size(h)).alias("g"), F.slice(g, 2, F.size(h)).alias("n"), running(sizes).alias("at"))
        return F.transform(zipped, span)

    def span(z: Column) -> Column:
        begin = z["at"] + F.length(z["g"])
        return F.struct(code.alias("kind"), begin.alias("start"), (begin + F.length(z["h"])).alias("end"), z["h"].alias("hit"), F.right(z["g"], F.lit(40)).alias("pre"), F.left(z["n"], F.lit(12)).alias("post"))

    p = F.lit(pattern)
    found = let(F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("h"), F.split(text, pattern, -1).alias("g")), lambda x: F.when(F.size(x["h"]) > 0, placed(x)))
    return F.coalesce(F.when(gate(text), found).cast(f"array<{_SPAN}>"), F.array().cast(f"array<{_SPAN}>"))


def _features(c: Column) -> dict[str, Column]:
    """Format and context of a candidate, all as doubles."""
    hit, pre, post = c["hit"], F.lower(c["pre"]), c["post"]
    digits = _digits(hit)
    cue = {
        "cue_phone": r"(?:phone|tel|call|mobile|cell|fax|contact|whatsapp|dial|number|tél|telefon|teléfono|llame|rufen|appelez)[^0-9]{0,18}$",
        "cue_mail": r"(?:mail|write|contact|reach|address|send|correo|escriba|schreiben|écrire|adresse)[^@]{0,18}$",
        "cue_ip": r"(?:ip|host|server|address|login|from|client|adresse|dirección)[^0-9]{0,14}$",
        "cue_card": r"(?:card|visa|mastercard|amex|credit|debit|pay|carte|karte|tarjeta)[^0-9]{0,18}$",
        "cue_other": r"(?:isbn|version|order|invoice|ref|id|no|nr|page|pages|date|section|year|score|total|price|part|serial|coordinates|figure)[.:# ]{0,4}$",
    }
    made = {k: pre.rlike(v) for k, v in cue.items()}
    made |= {
        "disguise": hit.rlike(r"[\[({<]"),
        "dot_word": hit.rlike(r"(?i)[ \[({<]dot[ \])}>]"),
        "top_level": hit.rlike(r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"),
        "year": hit.rlike(r"(?:19|20)[0-9]{2}"),
        "parens": hit.rlike(r"^\("),
        "trunk": digits.rlike("^0"),
        "spaced": hit.contains(" "),
        "after_word": F.length(pre) > 0,
        "after_digit": pre.rlike(r"[0-9][ .-]?$"),
        "before_digit": post.rlike(r"^[ .-]?[0-9]"),
    }
    n = F.length(digits)
    octets = F.split(F.regexp_replace(hit, "[^0-9]+", "."), r"\.")
    return {k: v.cast("double") for k, v in made.items()} | {
        "kind": c["kind"].cast("double"),
        "n_digits": n.cast("double"),
        "n_chars": F.length(hit).cast("double"),
        "groups": F.size(octets).cast("double"),
        "luhn": F.when(n.between(12, 19), luhn(digits)).otherwise(False).cast("double"),
        "octets": F.coalesce(F.forall(octets, lambda o: (F.length(o) < 4) & (F.coalesce(o.try_cast("int"), F.lit(0)) < 256)), F.lit(False)).cast("double"),
    }


NAMES = (
    "cue_phone", "cue_mail", "cue_ip", "cue_card", "cue_other", "disguise", "dot_word", "top_level", "year", "parens", "trunk",
    "spaced", "after_word", "after_digit", "before_digit", "kind", "n_digits", "n_chars", "groups", "luhn", "octets",
)


def candidates(docs: DataFrame, text: str, base: str, wide: str) -> DataFrame:
    """docs with the arrays base (valid exact spans) and wide (candidates with features f)."""
    src = free_name(docs, "pii_text")
    df = docs.withColumn(src, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    t = F.col(src)
    exact = F.concat(*[_kept(kind, _spans(t, kind, BASE[kind], _GATE[kind])) for kind in KINDS])
    plain = F.concat(*[_spans(t, kind, WIDE[kind], _WIDE_GATE[kind]) for kind in KINDS])
    with_features = F.transform(plain, lambda c: F.struct(c.alias("c"), F.struct(*[v.alias(k) for k, v in _features(c).items()]).alias("f")))
    return df.withColumns({base: exact, wide: with_features}).drop(src)


_PLACE = "array<struct<start:bigint,kind:int,end:bigint,base:boolean>>"


def _free(spans: Column) -> Column:
    """Of sorted spans, those of base and the others that overlap none of base."""
    far = 1 << 60
    until = running(F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(-1)), lambda a, b: F.greatest(a, b), -1)
    after = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(s["base"], s["start"]).otherwise(far))), lambda a, b: F.least(a, b), far))
    marked = F.arrays_zip(spans.alias("s"), until.alias("until"), after.alias("after"))
    kept = F.filter(marked, lambda z: z["s"]["base"] | ((z["until"] <= z["s"]["start"]) & (z["after"] >= z["s"]["end"])))
    return F.transform(kept, lambda z: z["s"])


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with out: array of (kind, start, end, base), by start, then kind as listed, then end.

    out gets underscores before it if docs has it. Offsets are code points, end
    exclusive; base tells exact spans from those that the trees selected, which stay
    only where no base span overlaps them. Null and empty texts have no spans, and the
    work grows little faster than a text's length. Repeated rows get equal results, an
    empty table an empty one; extra columns stay.
    """
    trees = model(docs.sparkSession)
    out = free_name(docs, out)
    base, wide = free_name(docs, "pii_base"), free_name(docs, "pii_wide")
    df = candidates(spread(docs), text, base, wide)
    chosen = F.expr(f"filter(`{wide}`, x -> {trees.sql('x.f')})")

    def slim(c: Column, exact: bool) -> Column:
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), F.lit(exact).alias("base"))

    exact = F.array_sort(F.transform(base, lambda c: slim(c, True))).cast(_PLACE)
    both = let(F.transform(chosen, lambda x: slim(x["c"], False)).cast(_PLACE), lambda w: F.when(F.size(w) > 0, let(F.array_sort(F.concat(exact, w)), _free)).otherwise(exact))
    named = F.transform(both, lambda s: F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    made = df.withColumn(out, named)
    return made.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{out}`"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of text replaced by its kind in capitals and brackets; overlapping spans become one, named after the first.

    Null texts stay null, empty ones empty. All columns are kept, whatever their names;
    repeated rows get equal texts, an empty table gives an empty one.
    """
    col = free_name(docs, "pii")
    df = find(docs, text, col)
    t = F.col(f"`{text}`")

    def piece(pieces: Column, z: Column) -> Column:
        tag = F.concat(cut(pieces, z["until"], z["s"]["start"]), F.lit("["), F.upper(z["s"]["kind"]), F.lit("]"))
        return F.when(z["s"]["start"] >= z["until"], tag).otherwise("")

    def whole(pieces: Column) -> Column:
        until = running(F.transform(col, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        marked = F.arrays_zip(F.col(f"`{col}`").alias("s"), until.alias("until"))
        rest = cut(pieces, F.array_max(F.transform(col, lambda s: s["end"])), F.length(t).cast("long"))
        return F.concat(F.array_join(F.transform(marked, lambda z: piece(pieces, z)), ""), rest)

    made = F.when(F.size(col) > 0, let(blocks(t), whole)).otherwise(t)
    kept = {c: F.col(f"`{c}`") for c in docs.columns} | {text: made.alias(text)}
    return df.select(*[kept[c] for c in docs.columns])


class Trees:
    """Boosted regression trees on the logistic loss; nodes are (feature, threshold, left, right) or leaves."""

    def __init__(self, x: list[list[float]], y: list[int], rounds: int = 30, depth: int = 3, rate: float = 0.3, least: int = 8):
        import numpy as np

        self.trees: list = []
        self.limits: dict[int, float] = {}
        X, Y = np.array(x, float), np.array(y, float)
        cuts = []  # midpoints between neighbouring values, 31 of them at most
        for column in X.T:
            values = np.unique(column)
            middle = (values[:-1] + values[1:]) / 2
            cuts.append(middle[np.unique(np.linspace(0, len(middle) - 1, min(31, len(middle))).astype(int))] if len(middle) else middle)
        bins = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, X.T)], 1) + 32 * np.arange(X.shape[1])
        score = np.zeros(len(Y))

        def sums(rows, weight):
            flat = np.bincount(bins[rows].ravel(), np.repeat(weight[rows], X.shape[1]), 32 * X.shape[1])
            return np.cumsum(flat.reshape(-1, 32), axis=1)

        def grow(rows, grad, hess, level):
            leaf = float(rate * grad[rows].sum() / (hess[rows].sum() + 1.0))
            if level == 0 or len(rows) < 2 * least:
                return leaf
            g, h, n = (sums(rows, w) for w in (grad, hess, np.ones(len(Y))))
            G, H = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + 1) + (G - g) ** 2 / (H - h + 1) - G**2 / (H + 1)
            gain[(n < least) | (len(rows) - n < least)] = 0
            f, k = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, k] <= 1e-6:
                return leaf
            cut = float(cuts[f][k])
            left = X[rows, f] <= cut
            return (int(f), cut, grow(rows[left], grad, hess, level - 1), grow(rows[~left], grad, hess, level - 1))

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree = grow(np.arange(len(Y)), Y - p, p * (1 - p), depth)
            self.trees.append(tree)
            score += np.array([self._walk(tree, r) for r in X])

    @staticmethod
    def _walk(node, row) -> float:
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    def score(self, row) -> float:
        return sum(self._walk(t, row) for t in self.trees)

    def calibrate(self, x: list[list[float]], y: list[int], precision: float = 0.99) -> None:
        """For each kind the lowest threshold above which held-out candidates reach that precision."""
        kind = NAMES.index("kind")
        for k in range(len(KINDS)):
            held = sorted(((self.score(r), t) for r, t in zip(x, y) if r[kind] == k), reverse=True)
            limit, good = float("inf"), 0
            for i, (s, t) in enumerate(held, 1):
                good += t
                if t and good / i >= precision:
                    limit = s
            self.limits[k] = max(limit, 0.0) - 1e-9 if limit != float("inf") else 1e9

    def sql(self, f: str) -> str:
        """Whether the feature struct f is selected, as SQL text."""

        def node(n) -> str:
            return f"{n!r}D" if not isinstance(n, tuple) else f"CASE WHEN {f}.{NAMES[n[0]]} <= {n[1]!r}D THEN {node(n[2])} ELSE {node(n[3])} END"

        limits = " ".join(f"WHEN {k} THEN {v!r}D" for k, v in self.limits.items())
        return f"({' + '.join(map(node, self.trees))}) >= CASE CAST({f}.kind AS INT) {limits} END"


def _luhn_fixed(r: random.Random, n: int) -> str:
    d = [r.randrange(10) for _ in range(n - 1)]
    s = sum(x if i % 2 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(reversed(d)))
    return "".join(map(str, d)) + str(-s % 10)


def examples(seed: int, n: int) -> list[tuple[str, int]]:
    """Generated sentences with one wide candidate each, and whether it is personal data."""
    r = random.Random(seed)
    name = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randrange(3, 9)))
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    filler = lambda: " ".join(name() for _ in range(r.randrange(1, 5)))
    tld = lambda: r.choice(["com", "org", "net", "de", "fr", "es", "info"])
    pair = lambda a: r.choice([f"[{a}]", f"({a})", f" [{a}] ", f" ({a}) ", f"{{{a}}}"])

    def grouped(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    out = []
    for _ in range(n):
        which = r.randrange(18)
        if which in (0, 1):
            cue = r.choice(["mail", "write to", "contact", "", "reach me:"])
            at, dot = pair("at"), r.choice([pair("dot"), "."])
            out.append((f"{filler()} {cue} {name()}.{name()}{at}{name()}{dot}{tld()}", 1))
        elif which == 2:
            out.append((f"{filler()} {r.choice(['mail', 'contact', 'write'])} {name()} at {name()} dot {tld()}", 1))
        elif which == 3:
            out.append((f"{filler()} {name()} at {name()}.{name()} {filler()}", 0))
        elif which == 4:
            out.append((f"{filler()} {name()} (at) {name()}.{r.choice([name(), d(2)])}", 0))
        elif which == 5:
            dot = r.choice(["[.]", "(.)", "[dot]"])
            good = r.random() < 0.7
            out.append((f"{filler()} {r.choice(['ip', 'host', 'from', 'server', ''])} " + dot.join(str(r.randrange(256) if good else r.randrange(256, 1000)) for _ in range(4)), int(good)))
        elif which in (6, 7):
            sep = r.choice([".", "/", "_", "  ", " - "[1:]])
            out.append((f"{filler()} {r.choice(['card', 'visa', 'pay with', 'credit card:', ''])} {grouped(_luhn_fixed(r, 16), sep)}", 1))
        elif which in (8, 9):
            sep = r.choice([".", "/", "_", "  "])
            s = d(16)
            while s == _luhn_fixed(random.Random(0), 16):
                s = d(16)
            out.append((f"{filler()} {r.choice(['order', 'id', 'serial', '', 'ref'])} {grouped(s, sep)}", 0))
        elif which in (10, 11):
            cue = r.choice(["tel", "phone:", "call", "mobile", "fax", "dial", "telefon", "tél.", "teléfono"])
            out.append((f"{filler()} {cue} " + r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"0{d(2)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)}-{d(3)}-{d(3)}", f"00 {d(2)} {d(3)} {d(3)} {d(3)}"]), 1))
        elif which == 12:
            out.append((f"{filler()} ({d(3)}) {d(3)}-{d(4)}", 1))
        elif which == 13:
            out.append((f"{filler()} {r.choice(['', 'date', 'on', 'page'])} {r.randrange(1900, 2100)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}", 0))
        elif which == 14:
            out.append((f"{filler()} {r.choice(['isbn', 'order', 'ref', 'no', 'serial', 'total', 'part', 'id', ''])} {d(3)}-{d(2)}-{d(4)}-{d(3)}", 0))
        elif which == 15:
            out.append((f"{filler()} {d(3)} {d(3)} {d(3)} {filler()}", 0))
        elif which == 16:
            out.append((f"{filler()} {d(2)} {d(2)} {d(2)} {d(2)} {filler()}", 0))
        else:
            out.append((f"{filler()} {r.choice(['', 'scores', 'pages'])} {d(3)}-{d(3)}-{d(4)}", 0))
    return out


@functools.lru_cache(maxsize=4)
def _fitted(session: int, seed: int, n: int) -> Trees:
    spark = SparkSession.getActiveSession()
    both = []
    for s, size in ((seed, n), (seed + 1, n // 2)):
        made = examples(s, size)
        texts = json.dumps([t for t, _ in made])
        rows = spark.range(1).select(F.posexplode(F.from_json(F.lit(texts), "array<string>")).alias("i", "text"))
        rows = candidates(rows, "text", "base", "wide").select("i", F.explode("wide").alias("w")).select("i", "w.f.*").collect()
        both.append(([[float(row[k] or 0) for k in NAMES] for row in rows], [made[row["i"]][1] for row in rows]))
    trees = Trees(*both[0])
    trees.calibrate(*both[1])
    return trees


def model(spark: SparkSession, seed: int = 11, n: int = 1500) -> Trees:
    """The trees, fitted once a process: generated sentences only, so it is the same for all data."""
    return _fitted(0, seed, n)
