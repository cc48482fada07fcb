"""Personal data: generators propose spans, boosted trees choose among those without a fixed format; JVM functions only.

Spans of the four base formats (e-mail, IP, card, phone) always stay. High-recall generators propose further,
overlapping ones: addresses spelled out, telephone numbers without a plus, long numbers with other separators, 3-2-4
numbers, colon-separated addresses. Each gets features of its format and context; the trees are a column expression.

The trees learn from snippets of the documents themselves: base spans in their context, as they are or disguised the way
people do (labelled 1), or spoiled so that nothing personal is left (labelled 0). At most ``TRAIN_ROWS`` documents are
read for that, those of least hash. The threshold is the least score at which nine tenths of held-out snippets chosen
are labelled 1.

Texts are read whole; null counts as empty. Patterns contain no group loops and do not restart quadratically.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import span_text, spans_of

#: Documents that snippets are cut from, boosted trees, their depth, learning rate.
TRAIN_ROWS, TREES, DEPTH, RATE = 2_000, 24, 3, 0.3
PRECISION = 0.9
CONTEXT = 24
#: Spans that are replaced in one go.
RUN = 64
#: Stand-ins for separators inside a candidate; the first one in a text is replaced by the second beforehand.
MARK, OTHER = "\ue000", "\ue001"
SPAN = "struct<start:long,end:long,body:string>"

BASE = ("email", "ip", "card", "phone")
EXTRA = ("spelled", "local", "number", "national", "colons")
# Formats.
EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+{MARK}-]))[A-Za-z0-9._%+{MARK}-]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
CARD = rf"[0-9{MARK}]{{14,}}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
GENERATORS = {
    "spelled": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{2,64}+ ?[\[(]?(?:at|AT|@)[\])]? ?[A-Za-z0-9-]{2,63}+(?: ?[\[(]?(?:dot|DOT)[\])]? ?[A-Za-z0-9-]{2,63}+){1,4}",
    "local": r"(?<![+0-9])[(0-9][0-9().\x20/-]{7,}[0-9]",
    "number": r"(?<![0-9])[0-9][0-9.\x20/_-]{12,}[0-9]",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "colons": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]{2,31}[0-9A-Fa-f](?![0-9A-Fa-f:])",
}
CUES = r"(?i:tel|phone|call|fax|mobil|card|visa|account|konto|mail|contact|kontakt|write|ssn|social|address|server|host)"
FEATURES = ("kind", "digits", "length", "luhn", "separators", "bracket", "cue", "left_word", "right_word", "distinct", "shape", "groups")


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes; longer ones do not."""
    n = F.length(digits)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def value(i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        doubled = d * 2
        return F.when(i % 2 == 1, d).when(doubled > 9, doubled - 9).otherwise(doubled)

    total = F.aggregate(F.transform(at, value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.when(n.between(1, 19), total % 10 == 0).otherwise(False)


def _when(cond: Column, spans: Column) -> Column:
    return F.when(cond, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of struct(start, end, body) for each base kind."""
    text = F.translate(text, MARK, OTHER)
    dotted = F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    joined = F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", MARK)
    card_digits = lambda s: F.regexp_replace(s["body"], MARK, "")
    return {
        "email": _when(F.contains(text, F.lit("@")), spans_of(dotted, EMAIL)),
        "ip": _when(text.rlike(r"[0-9]\.[0-9]"), F.filter(spans_of(text, IP), lambda s: s["body"].rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))),
        "card": _when(text.rlike(r"[0-9][0-9\x20-]{12,}[0-9]"), F.filter(spans_of(joined, CARD), lambda s: F.length(card_digits(s)).between(14, 19) & _luhn(card_digits(s)))),
        "phone": _when(text.rlike(r"\+[0-9]"), F.filter(spans_of(text, PHONE), lambda s: F.length(_digits(s["body"])).between(10, 15))),
    }


def candidates(text: Column) -> Column:
    """Array of struct(start, end, kind, features) of what the generators propose, kinds in the order of EXTRA."""
    hints = {"spelled": F.contains(F.lower(text), F.lit("dot")), "local": text.rlike(r"[0-9][0-9().\x20/-]{7,}[0-9]"), "number": text.rlike(r"[0-9][0-9.\x20/_-]{12,}[0-9]"),
             "national": text.rlike(r"[0-9]-[0-9]{2}-[0-9]"), "colons": text.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:")}

    def described(kind: int, s: Column) -> Column:
        digits = _digits(s["body"])
        left = F.substr(text, F.greatest(s["start"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(s["start"], F.lit(CONTEXT)).cast("int"))
        right = F.substr(text, s["end"].cast("int") + 1, F.lit(1))
        f = {
            "kind": F.lit(kind), "digits": F.length(digits), "length": F.length(s["body"]), "luhn": _luhn(digits).cast("int"),
            "separators": F.length(F.regexp_replace(s["body"], r"[^\x20./_():-]", "")), "bracket": s["body"].rlike(r"[\[(]").cast("int"), "cue": left.rlike(CUES).cast("int"),
            "left_word": left.rlike(r"[A-Za-z0-9]$").cast("int"), "right_word": right.rlike(r"[A-Za-z0-9]").cast("int"),
            "distinct": F.size(F.array_distinct(F.split(digits, ""))), "shape": s["body"].rlike(r"[0-9]{3}[^0-9]{1,3}[0-9]{3}[^0-9]{1,3}[0-9]{4}$").cast("int"),
            "groups": F.size(F.split(s["body"], "[^0-9]+"))}
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(EXTRA[kind]).alias("kind"),
                        F.array(*[f[k].cast("double") for k in FEATURES]).alias("f"))

    def proposed(kind: int) -> Column:
        found = _when(hints[EXTRA[kind]], spans_of(text, GENERATORS[EXTRA[kind]]))
        return F.transform(found, lambda s: described(kind, s))

    return F.concat(*[proposed(i) for i in range(len(EXTRA))])


# Boosted trees: a tree is a value, or (feature, threshold, tree at or below it, tree above it).

def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    value = float(g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 8:
        return value
    best = (1e-6, None, None)
    for k in range(x.shape[1]):
        for t in np.unique(x[:, k])[:-1][:64]:
            low = x[:, k] <= t
            gl, hl, gr, hr = g[low].sum(), h[low].sum(), g[~low].sum(), h[~low].sum()
            gain = gl * gl / (hl + 1) + gr * gr / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
            if gain > best[0]:
                best = (gain, k, float(t))
    if best[1] is None:
        return value
    _, k, t = best
    low = x[:, k] <= t
    return k, t, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    k, t, a, b = tree
    return np.where(x[:, k] <= t, _value(a, x), _value(b, x))


@dataclass(frozen=True)
class Trees:
    """Log-odds are ``bias`` and the trees' sum; a candidate is chosen from ``threshold`` on."""

    bias: float
    trees: tuple
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.bias + RATE * sum((_value(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, f: Column) -> Column:
        def walk(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(RATE * tree)
            k, t, a, b = tree
            return F.when(F.get(f, F.lit(k)) <= t, walk(a)).otherwise(walk(b))

        out = F.lit(self.bias)
        for t in self.trees:
            out = out + walk(t)
        return out


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting on three of four rows; the fourth ones calibrate the threshold."""
    if not len(y) or y.min() == y.max():
        return Trees(0.0, (), math.inf if not len(y) or y.max() == 0 else 0.0)
    held = np.arange(len(y)) % 4 == 3
    xt, yt = x[~held], y[~held]
    rate = float(np.clip(yt.mean(), 0.01, 0.99))
    bias = math.log(rate / (1 - rate))
    raw, trees = np.full(len(yt), bias), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        trees.append(_grow(xt, yt - p, p * (1 - p), DEPTH))
        raw = raw + RATE * _value(trees[-1], xt)
    model = Trees(bias, tuple(trees), 0.0)
    s, truth = model.score(x[held]), y[held]
    order = np.argsort(-s, kind="stable")
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= PRECISION)
    return Trees(bias, tuple(trees), max(0.0, float(s[order[good[-1]]])) if len(good) else math.inf)


def snippets(docs: DataFrame) -> DataFrame:
    """text, label: base spans in their context, disguised or spoiled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    some = docs.select(text.alias("text")).where(F.contains(text, F.lit("@")) | text.rlike("[0-9]{3}")).orderBy(F.xxhash64("text"), "text").limit(TRAIN_ROWS)
    base = base_spans(F.col("text"))
    cut = some.select("text", *[base[k].alias(k) for k in BASE])
    spans = F.concat(*[F.transform(k, _named(k)) for k in BASE])
    rows = cut.select("text", F.explode(spans).alias("s"))
    body = F.expr("substr(text, int(s.start) + 1, int(s.end - s.start))")
    left = F.expr(f"substr(text, int(greatest(s.start - {CONTEXT}, 0)) + 1, int(least(s.start, {CONTEXT})))")
    right = F.expr(f"substr(text, int(s.end) + 1, {CONTEXT})")
    spoiled_digits = F.translate(body, "0123456789", "1357902468")

    def variant(kind: str, value: Column, label: int) -> Column:
        return F.when(F.col("s.kind") == kind, F.struct(F.concat(left, value, right).alias("text"), F.lit(label).alias("label")))

    address = F.regexp_replace(body, r"^.*?([A-Za-z0-9_-]+@)", "$1")
    options = [
        variant("email", F.regexp_replace(F.regexp_replace(address, "@", " at "), r"\.", " dot "), 1),
        variant("email", F.regexp_replace(F.regexp_replace(body, "@", " [at] "), r"\.", " [dot] "), 1),
        variant("phone", F.regexp_replace(body, r"^\+", ""), 1),
        variant("phone", F.regexp_replace(body, r"^\+[0-9]+ ?", ""), 1),
        variant("phone", F.concat(F.lit("1"), _digits(spoiled_digits)), 0),
        variant("phone", F.regexp_replace(_digits(body), "(..)(?=.)", "$1."), 0),
        variant("card", F.regexp_replace(body, "(.{4})(?=.)", "$1."), 1),
        variant("card", F.regexp_replace(F.concat(F.expr("substr(text, int(s.start) + 1, int(s.end - s.start) - 1)"), (F.expr("cast(substr(text, int(s.end), 1) as int)") + 1) % 10), "(.{4})(?=.)", "$1."), 0),
        variant("card", F.concat(spoiled_digits, F.lit("00000")), 0),
        variant("ip", F.regexp_replace(body, r"\.", "-"), 0),
        variant("ip", F.regexp_replace(body, r"\.", ":"), 0),
    ]
    return rows.select(F.explode(F.array_compact(F.array(*options))).alias("v")).select("v.text", "v.label")


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def train(docs: DataFrame) -> Trees:
    """Fit on the candidates that lie in the middle of the snippets."""
    found = snippets(docs).select("label", F.length("text").alias("n"), F.explode(candidates(F.col("text"))).alias("c"))
    mid = found.where((F.col("c.start") < F.col("n") - CONTEXT + 2) & (F.col("c.end") > F.least(F.lit(CONTEXT), F.col("n") / 2)))
    rows = mid.select(F.col("c.f").alias("f"), "label").orderBy(F.xxhash64("f"), "label").collect()  # a few for each of TRAIN_ROWS documents
    return fit(np.array([r["f"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["label"] for r in rows], float))


def personal_data(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``pii``: a struct with an array of spans for each kind of BASE and EXTRA.

    Spans that the trees choose do not overlap base spans; among themselves they may. A column named ``pii`` is replaced.
    """
    model = model or train(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base_spans(text)
    # The parts are kept apart by names of their own, so that each is computed once.
    rows = docs.drop("pii").withColumns({f"_{k}": base[k] for k in BASE} | {"_c": candidates(text)})
    every = F.concat(*[F.transform(f"_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in BASE])
    rows = rows.withColumn("_all", every)
    chosen = F.filter("_c", lambda c: (model.column(c["f"]) >= model.threshold) & ~F.exists(F.col("_all"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))) if model.trees \
        else F.filter("_c", lambda c: F.lit(False))
    rows = rows.withColumn("_x", chosen)

    def plain(c: Column) -> Column:
        return F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def of_kind(kind: str) -> Column:
        return plain(F.filter("_x", lambda c: c["kind"] == kind)).alias(kind)

    pii = F.struct(*[plain(F.col(f"_{k}")).alias(k) for k in BASE], *[of_kind(k) for k in EXTRA])
    return rows.withColumn("pii", pii).drop(*[f"_{k}" for k in BASE], "_c", "_all", "_x")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text."""
    kinds = [(k, F.col(f"pii.{k}")) for k in (*BASE, *EXTRA)]
    return found.select("doc_id", *[F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in BASE],
                        F.sha2(span_text(kinds[:len(BASE)]).cast("binary"), 256).alias("base_sha256"), span_text(kinds).alias("spans"))


def redacted(found: DataFrame) -> DataFrame:
    """The rows of ``personal_data`` with every span of the text replaced by its kind in brackets; ``pii`` goes.

    Sorted spans are taken ``RUN`` at a time: a run starts where the spans before it end and copies its own stretch of
    the text only, so that very many spans do not copy a long text each. Of spans that overlap the first one gives the kind.
    """
    def tagged(kind: str) -> Column:
        return F.transform(f"pii.{kind}", lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), F.lit(f"[{kind.upper()}]").alias("tag")))

    rows = found.withColumn("_pii_spans", F.array_sort(F.concat(*[tagged(k) for k in (*BASE, *EXTRA)])))
    runs = F.transform(F.sequence(F.lit(0), F.greatest((F.size("_pii_spans") - 1).cast("int"), F.lit(0)), F.lit(RUN)), lambda i: F.slice("_pii_spans", i + 1, F.lit(RUN)))
    ends = F.transform("_pii_runs", lambda r: F.array_max(F.transform(r, lambda s: s["end"])))
    rows = rows.withColumn("_pii_runs", runs).withColumn("_pii_ends", ends)

    def replaced(run: Column, i: Column) -> Column:
        begin = F.coalesce(F.array_max(F.slice("_pii_ends", F.lit(1), i)), F.lit(0))
        end = F.greatest(begin, F.element_at("_pii_ends", i + 1))
        stretch = F.substr(F.col("text"), begin + 1, end - begin)

        def step(acc: Column, s: Column) -> Column:
            ahead = F.substr(acc["of"], acc["at"] - acc["begin"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            fresh = F.struct(acc["begin"].alias("begin"), acc["of"].alias("of"), s["end"].alias("at"), F.concat(acc["out"], ahead, s["tag"]).alias("out"))
            inside = F.struct(acc["begin"].alias("begin"), acc["of"].alias("of"), F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
            return F.when(s["start"] >= acc["at"], fresh).otherwise(inside)

        start = F.struct(begin.alias("begin"), stretch.alias("of"), begin.alias("at"), F.lit("").alias("out"))
        return F.aggregate(run, start, step, lambda acc: acc["out"])

    last = F.array_max("_pii_ends")
    out = F.concat(F.array_join(F.transform("_pii_runs", replaced), ""), F.substr(F.col("text"), last + 1, F.length("text")))
    return rows.withColumn("text", F.when(F.size("_pii_spans") > 0, out).otherwise(F.col("text"))).drop("pii", "_pii_spans", "_pii_runs", "_pii_ends")
