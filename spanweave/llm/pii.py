"""Personal data by candidate generation and gradient-boosted trees, all in DataFrame functions.

1. Strict patterns give the base spans of each kind; several loose ones a kind give overlapping candidates, with binned features
   of format (digits, separators, groups, brackets, check digits) and context (words and characters around).  One scan of the
   texts does both.
2. Candidates that a base span of their kind confirms are positive examples, and so are they written otherwise (other or no
   separators, no country sign, spelt-out or bracketed signs); negative ones are candidates without confirmation and confirmed
   ones spoilt (a digit changed, a part out of range, too short, without a domain's end).  Rows are reduced to counts by feature
   combination, a bounded table, from which boosted trees of depth two are fitted, an ensemble a kind; a fifth of the documents
   is held out, and each kind's threshold is the least score whose held-out precision, smoothed, reaches ``PRECISION``.
3. The trees are applied as one expression.  A candidate over its threshold becomes a span unless it touches a base span or a
   better one; base spans always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone")

#: Base patterns.  Possessive quantifiers and the look-behinds only spare retries that cannot match; they change no match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this needs no search for the kind.
HINT = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?+){15}[0-9]", "phone": r"\+[0-9]"}
#: Loose patterns of candidates, several a kind (the key without its number): any token around an at sign, spelt-out and bracketed
#: signs, dotted or spaced numbers, long digit strings, single card and phone numbers within longer ones, digit groups with brackets.
LOOSE = {
    "email": r"(?:\G|(?<![^\s@]))[^\s@]++@[^\s@]++",
    "email2": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?[\[({<]?\s?(?:@|(?i:at))\s?[\])}>]?\s?[A-Za-z0-9-]{1,63}+(?:\s?[\[({<]?\s?(?:\.|\b(?i:dot)\b)\s?[\])}>]?\s?[A-Za-z0-9-]{2,63}+){1,4}",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,7}+",
    "ip2": r"(?<![0-9.])[0-9]{1,3}+(?:\s?[\[({]?[.,][\])}]?\s?[0-9]{1,3}+){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[\x20._-]?[0-9]){11,23}+",
    "card2": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(])\+?\(?[0-9](?:[\x20().-]{0,3}[0-9]){6,15}+",
    "phone2": r"(?<![0-9+(])(?:\+?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20./-]?[0-9]{3}[\x20./-]?[0-9]{4}(?![0-9])",
}
LOOSE_HINT = {"email": r"@", "email2": r"(?i:[\[({<\x20]at[\])}>\x20])|\s@|@\s|[\[({<]@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "ip2": r"[0-9]\s?[\[({]?[.,][\])}]?\s?[0-9]{1,3}\s?[\[({]?[.,]", "card": r"(?:[0-9][\x20._-]?+){11}[0-9]", "card2": r"[0-9]{4}[\x20._/-]?[0-9]{4}", "phone": r"[0-9](?:[\x20().-]{0,3}[0-9]){6}", "phone2": r"[0-9]{3}[\x20./-]?[0-9]{4}"}

#: Confirmed strings written otherwise: (pattern, replacement) steps of each variant.
OTHERWISE = {
    "email": ([("@", " (at) ")], [("@", "[at]"), (r"\.", "[dot]")], [("@", " at "), (r"\.", " dot ")], [("@", " @ ")]),
    "ip": ([(r"\.", "[.]")], [(r"\.", " . ")], [(r"\.", "(.)")]),
    "card": ([("[^0-9]", ""), ("(.{4})(?=.)", "$1.")], [("[^0-9]", ""), ("(.{4})(?=.)", "$1/")], [("[^0-9]", ""), ("(.{4})(?=.)", "$1_")], [("[^0-9]", "")], [("[^0-9]", ""), ("(.{4})(?=.)", "$1 ")]),
    "phone": ([(r"^\+[0-9]{1,3}[\x20.-]?(?=.{8})", "")], [(r"^\+[0-9]{1,3}[\x20.-]?(?=.{8})", ""), ("[^0-9]+", "-"), ("^-", "")], [(r"^\+[0-9]{1,3}[\x20.-]?(?=.{8})", ""), ("[^0-9]+", "."), (r"^\.", "")], [(r"^\+", "")]),
}
#: Confirmed strings spoilt.
SPOILT = {
    "email": ([(r"\.[^@]*$", "")], [("@", " at "), (r" at ([A-Za-z0-9-]+).*$", " at $1")]),
    "ip": ([("^[0-9]+", "999")], [(r"\.[0-9]+$", "")], [("$", ".7")]),
    "card": ([("0$", "x"), ("[1-9]$", "0"), ("x$", "5")], [("[^0-9]", ""), ("0$", "x"), ("[1-9]$", "0"), ("x$", "5")], [("[0-9]{3}$", "")]),
    "phone": ([(r"^\+", ""), ("[0-9]{4}$", "")], [(r"[^0-9]", ""), ("$", "0017")], [(r"[^0-9]", ""), ("^(.{4}).*$", "$1-01-01")]),
}

#: Context words that speak for each kind.
CUES = {"email": r"mail|contact|write", "ip": r"\bip\b|host|server|addr", "card": r"card|visa|credit|pay", "phone": r"phone|tel|call|fax|mobile"}

FEATURES = ("kind", "digits", "separators", "groups", "opening", "closing", "cue", "shape")
TREES, RATE, PRECISION = 16, 0.3, 0.95  # trees a kind


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn test."""
    at = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, at(i)).when(at(i) * 2 > 9, at(i) * 2 - 9).otherwise(at(i) * 2))
    return (F.length(digits) > 0) & (total % 10 == 0)


def _holds(kind: str, s: Column) -> Column:
    """Whether a match of the base pattern counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: p.rlike(r"^0*(?:[1-9]?[0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(s)).between(16, 19) & luhn(_digits(s))
    return F.length(_digits(s)).between(8, 15)


def _located(df: DataFrame, text: str, patterns: dict[str, str], hints: dict[str, str], out: str) -> DataFrame:
    """Adds ``out``: array of (kind, start, end, s, before) of all matches, in code points.

    Offsets are running sums over the pieces between matches, so a text is searched once a kind and only if its hint matches.
    """
    pieces = {f"__m{k}": F.when(F.col(text).rlike(hints[k]), F.regexp_extract_all(text, F.lit(patterns[k]), F.lit(0))) for k in patterns}
    df = df.select("*", *[v.alias(k) for k, v in pieces.items()])
    df = df.select("*", *[F.when(F.size(f"__m{k}") > 0, F.split(text, patterns[k], -1)).alias(f"__p{k}") for k in patterns])
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,s:string,before:string,after:string>>")
    kind = "struct<at:bigint,out:array<struct<kind:string,start:bigint,end:bigint,s:string,before:string,after:string>>>"

    def walked(k: str) -> Column:
        m, p = F.col(f"__m{k}"), F.col(f"__p{k}")

        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.length(F.get(p, i))
            end = begin + F.length(F.get(m, i))
            one = F.struct(F.lit(k.rstrip("0123456789")).alias("kind"), begin.alias("start"), end.alias("end"), F.get(m, i).alias("s"), F.right(F.get(p, i), F.lit(24)).alias("before"), F.left(F.get(p, i + 1), F.lit(1)).alias("after"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")).cast(kind)

        whole = F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")).cast(kind), step, lambda acc: acc["out"])
        return F.when(F.size(p) > 0, whole).otherwise(none)

    found = [walked(k) for k in patterns]
    return df.withColumn(out, F.concat(*found)).drop(*pieces, *[f"__p{k}" for k in patterns])


def _features(c: Column) -> Column:
    """Binned features of a candidate; small numbers, so that their combinations are few."""
    s, d = c["s"], F.length(_digits(c["s"]))
    digits = F.when(d < 7, 0).when(d < 10, 1).when(d == 10, 2).when(d < 12, 3).when(d < 16, 4).when(d == 16, 5).when(d < 20, 6).otherwise(7)
    n = F.length(F.regexp_replace(s, "[A-Za-z0-9]", ""))
    separators = F.when(n == 0, 0).when(n < 3, 1).when(n == 3, 2).when(n < 7, 3).otherwise(4)
    g = F.size(F.split(s, "[^A-Za-z0-9]+"))
    groups = F.when(g < 3, 0).when(g == 3, 1).when(g == 4, 2).when(g < 7, 3).otherwise(4)
    char = lambda x: F.when(x == "", 0).when(x.rlike(r"^\s$"), 1).when(x.rlike("^[.,;:!?)\"']$"), 2).otherwise(3)
    cue = F.coalesce(*[F.when(c["kind"] == k, F.lower(c["before"]).rlike(v).cast("int")) for k, v in CUES.items()])
    top = r"(?:\.|(?i:dot))[\])}>\s]*[A-Za-z]{2,}$"
    parts = F.split(s, r"[^0-9]+")
    last = lambda lo: F.regexp_like(s, F.lit(rf"(?:^|[^0-9])[0-9]{{3}}[^0-9]+[0-9]{{{lo}}}$"))
    shape = F.when(c["kind"] == "email", s.rlike(top).cast("int") + 2 * s.rlike(r"@|(?i:[\[({<\s]at[\])}>\s])").cast("int"))
    shape = shape.when(c["kind"] == "card", luhn(_digits(s)).cast("int") + 2 * s.rlike(r"^[0-9]{4}([^0-9]?)[0-9]{4}\1[0-9]{4}\1[0-9]").cast("int"))
    shape = shape.when(c["kind"] == "phone", last(4).cast("int") + 2 * s.rlike(r"^[+(]").cast("int"))
    shape = shape.otherwise((F.size(parts) == 4).cast("int") + 2 * F.forall(parts, lambda p: (F.length(p) < 4) & (F.coalesce(p.try_cast("int"), F.lit(999)) < 256)).cast("int"))
    kind = F.coalesce(*[F.when(c["kind"] == k, F.lit(i)) for i, k in enumerate(KINDS)])
    return F.struct(*[v.cast("int").alias(k) for k, v in zip(FEATURES, (kind, digits, separators, groups, char(F.right(c["before"], F.lit(1))), char(c["after"]), cue, shape), strict=True)])


def _touches(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def candidates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base, loose): base spans and candidates (kind, start, end, x: features, y: the same as a base span, own: text and context of such)."""
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = _located(src, "text", BASE, HINT, "base")
    src = src.withColumn("base", F.filter("base", lambda b: F.coalesce(*[F.when(b["kind"] == k, _holds(k, b["s"])) for k in KINDS])))
    src = _located(src, "text", LOOSE, LOOSE_HINT, "loose")
    span = lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"))
    confirmed = lambda c: F.exists("base", lambda b: (b["kind"] == c["kind"]) & (b["start"] == c["start"]) & (b["end"] == c["end"]))
    cand = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), _features(c).alias("x"), confirmed(c).alias("y"), F.when(confirmed(c), F.struct(c["s"].alias("s"), c["before"].alias("before"), c["after"].alias("after"))).alias("own"))
    return src.select("id", F.transform("base", span).alias("base"), F.transform("loose", cand).alias("loose"))


class BoostedTrees:
    """By kind: a bias, trees of depth two (feature, cut, feature, cut, feature, cut, four leaf values) and a threshold on the score."""

    def __init__(self):
        self.bias: dict[str, float] = {}
        self.trees: dict[str, list[tuple]] = {}
        self.thresholds: dict[str, float] = {}

    def score(self, x: tuple[int, ...]) -> float:
        kind = KINDS[x[0]]
        out = self.bias.get(kind, 0.0)
        for f, c, fl, cl, fr, cr, v in self.trees.get(kind, ()):
            out += (v[0] if x[fl] <= cl else v[1]) if x[f] <= c else (v[2] if x[fr] <= cr else v[3])
        return out

    def column(self, kind: Column, x: Column) -> Column:
        """The score as an expression; null for kinds without a threshold."""
        at = lambda f: x[FEATURES[f]]
        by_kind = []
        for k in self.thresholds:
            out = F.lit(self.bias[k])
            for f, c, fl, cl, fr, cr, v in self.trees[k]:
                out = out + F.when(at(f) <= c, F.when(at(fl) <= cl, F.lit(v[0])).otherwise(F.lit(v[1]))).otherwise(F.when(at(fr) <= cr, F.lit(v[2])).otherwise(F.lit(v[3])))
            by_kind.append(F.when(kind == k, out))
        return F.coalesce(*by_kind)


def _best_cut(rows: list[tuple]) -> tuple[float, int, int]:
    """(gain, feature, cut) of the best split of (x, gradient, curvature) rows."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (0.0, 0, 99)
    for f in range(len(FEATURES)):
        sums: dict[int, list[float]] = {}
        for x, a, b in rows:
            s = sums.setdefault(x[f], [0.0, 0.0])
            s[0] += a
            s[1] += b
        gl = hl = 0.0
        for v in sorted(sums)[:-1]:
            gl, hl = gl + sums[v][0], hl + sums[v][1]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0] + 1e-9:
                best = (gain, f, v)
    return best


def _grown(own: list[tuple[tuple[int, ...], bool, int]]) -> tuple[float, list[tuple]]:
    """Bias and trees of one kind's (features, label, count) rows."""
    pos, neg = sum(n for _, y, n in own if y), sum(n for _, y, n in own if not y)
    bias, trees = math.log((pos + 0.5) / (neg + 0.5)), []
    score = {x: bias for x, *_ in own}
    leaf = lambda rs: RATE * sum(r[1] for r in rs) / (sum(r[2] for r in rs) + 1)
    for _ in range(TREES):
        grad = []
        for x, y, n in own:
            p = 1 / (1 + math.exp(-score[x]))
            grad.append((x, n * (y - p), n * p * (1 - p)))
        _, f, c = _best_cut(grad)
        sides = [[r for r in grad if r[0][f] <= c], [r for r in grad if r[0][f] > c]]
        (_, fl, cl), (_, fr, cr) = (_best_cut(s) for s in sides)
        leaves = [[r for r in sides[k] if (r[0][f2] <= c2) == low] for k, f2, c2 in ((0, fl, cl), (1, fr, cr)) for low in (True, False)]
        v = [leaf(x) if x else 0.0 for x in leaves]
        trees.append((f, c, fl, cl, fr, cr, v))
        for x in score:
            score[x] += (v[0] if x[fl] <= cl else v[1]) if x[f] <= c else (v[2] if x[fr] <= cr else v[3])
    return bias, trees


def fit(rows: list[tuple[tuple[int, ...], bool, bool, int]]) -> BoostedTrees:
    """Model of (features, label, held out, count) rows; a kind without positive examples has no threshold, so none of its candidates passes."""
    m = BoostedTrees()
    for k, kind in enumerate(KINDS):
        own = [(x, y, n) for x, y, held, n in rows if not held and x[0] == k]
        if not any(y for _, y, _ in own):
            continue
        m.bias[kind], m.trees[kind] = _grown(own)
        # calibration: the least score from which on held-out candidates are positive often enough
        held = sorted(((m.score(x), y, n) for x, y, h, n in rows if h and x[0] == k), reverse=True)
        good = all_ = 0
        for i, (s, y, n) in enumerate(held):
            good, all_ = good + n * y, all_ + n
            if (i + 1 == len(held) or held[i + 1][0] < s) and good + 0.5 >= PRECISION * (all_ + 1):
                m.thresholds[kind] = s
    return m


def _rewritten(own: Column, kind: Column, steps: dict[str, tuple]) -> Column:
    """Features of a confirmed candidate's variants."""
    by_kind = []
    for k, variants in steps.items():
        made = []
        for chain in variants:
            text = own["s"]
            for old, new in chain:
                text = F.regexp_replace(text, old, new)
            made.append(_features({"kind": F.lit(k), "s": text, "before": own["before"], "after": own["after"]}))
        by_kind.append(F.when(kind == k, F.array(*made)))
    return F.coalesce(*by_kind)


def train(cand: DataFrame) -> BoostedTrees:
    """Fit on all candidates and the variants of all confirmed ones, reduced to counts: at most a row for each combination of bins."""
    one = cand.select(F.coalesce(F.pmod(F.xxhash64("id"), F.lit(5)) == 0, F.lit(False)).alias("held"), F.explode("loose").alias("c"))
    plain = one.select("held", "c.x", "c.y")
    sure = one.where("c.y")
    good, bad = (sure.select("held", F.explode(_rewritten(F.col("c.own"), F.col("c.kind"), steps)).alias("x"), F.lit(y).alias("y")) for steps, y in ((OTHERWISE, True), (SPOILT, False)))
    rows = plain.union(good).union(bad).groupBy("x", "y", "held").count().collect()
    return fit(sorted((tuple(r["x"]), r["y"], r["held"], r["count"]) for r in rows))


def redact_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): base spans and those the trees add, as arrays of (kind, start, end), code points, end exclusive.

    Null texts are empty and have no spans; null and repeated ids are rows of their own; other columns are not read.
    """
    cand = materialize(candidates(df, id_col, text_col), "candidates")
    m = train(cand)
    if not m.thresholds:
        return cand.select(F.col("id").alias(id_col), "base", F.slice("base", 1, 0).alias("added"))
    least = lambda c: F.coalesce(*[F.when(c["kind"] == k, F.lit(t)) for k, t in m.thresholds.items()], F.lit(1e9))
    scored = F.transform(F.filter("loose", lambda c: ~c["y"] & ~F.exists("base", lambda b: _touches(b, c))), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), m.column(c["kind"], c["x"]).alias("score")))
    out = cand.select("id", "base", scored.alias("c")).withColumn("c", F.filter("c", lambda c: c["score"] >= least(c)))
    better = lambda a, b: _touches(a, b) & ((b["score"] > a["score"]) | (b["score"] == a["score"]) & (F.struct(b["start"], b["end"], b["kind"]) < F.struct(a["start"], a["end"], a["kind"])))
    out = out.withColumn("c", F.array_distinct("c"))  # generators may propose the same span
    added = F.transform(F.filter("c", lambda a: ~F.exists("c", lambda b: better(a, b))), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return out.select(F.col("id").alias(id_col), "base", added.alias("added"))


def spans_text(spans: Column) -> Column:
    """kind:start:end by kind as listed, then by start, joined by commas."""
    rank = F.create_map(*[v for i, k in enumerate(KINDS) for v in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda c: F.struct(F.element_at(rank, c["kind"]).alias("r"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents; the counts are of base spans."""
    found = redact_spans(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(number, KINDS), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


QUERIES = {"op6_pii": op6_pii}
ORACLE_SQL: dict[str, str] = {}
