"""Secret scans over an incremental ledger of blobs, in JVM functions only.

Every version of every path is addressed by the SHA-256 of its content. A blob is scanned once per rule version: pairs
that the ledger holds already are left out, whatever number of paths or versions share the blob. Findings are joined
back to all paths by the address. Only texts that a cheap test of some rule lets through travel with their address.

A null text is the empty one. Long texts are scanned whole; patterns have no group loops and no quadratic restarts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import span_text, spans_of

SPANS = "array<struct<start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """``hint``: texts, one of which every match contains. ``least``: fewest characters of ``group``."""

    name: str
    version: int
    pattern: str
    hint: tuple[str, ...]
    group: int = 0
    least: int = 0
    base: bool = False


# Formats of credentials.
RULES = (
    Rule("assign", 1, r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", (":", "="), 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", ("AKIA",), base=True),
    Rule("hex", 1, r"[0-9a-f]{24,}", (), base=True),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]{35,}", ("AIza",)),
    Rule("stripe", 1, r"sk_live_[A-Za-z0-9]{16,}", ("sk_live_",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ",)),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("-----BEGIN",)),
)


def _may_match(text: Column, rule: Rule) -> Column:
    hinted = F.lit(not rule.hint)
    for h in rule.hint:
        hinted = hinted | F.contains(text, F.lit(h))
    return hinted & text.rlike(rule.pattern)


def _matches(text: Column, rule: Rule) -> Column:
    found = spans_of(text, rule.pattern, rule.group)
    if rule.least:
        found = F.filter(found, lambda s: F.length(s["body"]) >= rule.least)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def pending_blobs(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, body, pending: blobs with at least one rule version that the ledger lacks; body only where a rule may match."""
    body = F.coalesce(F.col(text), F.lit(""))
    any_rule = F.lit(False)
    for r in rules:
        any_rule = any_rule | _may_match(body, r)
    blobs = versions.select(address(F.col(text)).alias("blob"), F.when(any_rule, body).alias("body")).groupBy("blob").agg(F.max("body").alias("body"))
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        return blobs.withColumn("pending", pairs)
    seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))  # as many entries as rule versions
    return blobs.join(seen, "blob", "left").select("blob", "body", F.when(F.col("seen").isNull(), pairs).otherwise(F.array_except(pairs, "seen")).alias("pending")).where(F.size("pending") > 0)


def scan(pending: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rule, version, spans), one for each pending pair; spans are empty where nothing was found."""
    rows = []
    for r in rules:
        due = F.array_contains("pending", F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")))
        spans = F.when(due & _may_match(F.col("body"), r), _matches(F.col("body"), r)).otherwise(F.array().cast(SPANS))
        rows.append(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans.alias("spans"), due.alias("due")))
    return pending.select("blob", F.explode(F.array(*rows)).alias("r")).where("r.due").select("blob", "r.rule", "r.version", "r.spans")


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and an array of spans per rule, at the rules' versions, for blobs with a finding."""
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("rule") == r.name) & (F.col("version") == r.version))
    hits = ledger.where((F.size("spans") > 0) & current)
    return hits.groupBy("blob").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("spans"))).alias(r.name) for r in rules])


def secrets_of(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of ``versions`` but the text, with ``secrets``: a struct with an array of spans per rule.

    ``ledger`` holds what earlier runs scanned; append ``scan(pending_blobs(...))`` to it to carry it on.
    """
    rows = scan(pending_blobs(versions, text, ledger, rules), rules)
    ledger = rows if ledger is None else ledger.select(rows.columns).unionByName(rows)
    found = findings(ledger, rules).select(F.col("blob").alias("_blob"), F.struct(*[F.coalesce(r.name, F.array().cast(SPANS)).alias(r.name) for r in rules]).alias("_secrets"))
    none = F.struct(*[F.array().cast(SPANS).alias(r.name) for r in rules])
    paths = versions.withColumn("_address", address(F.col(text))).drop(text)
    kept = [c for c in versions.columns if c not in (text, "secrets")]
    return paths.join(found, F.col("_address") == F.col("_blob"), "left").select(*kept, F.coalesce("_secrets", none).alias("secrets"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts and digest of the base rules' spans, and all spans as text."""
    base = [r for r in rules if r.base]
    return found.select(
        "doc_id", *[F.size(f"secrets.{r.name}").cast("long").alias(f"n_{r.name}") for r in base],
        F.sha2(span_text([(r.name, F.col(f"secrets.{r.name}")) for r in base]).cast("binary"), 256).alias("base_sha256"),
        span_text([(r.name, F.col(f"secrets.{r.name}")) for r in rules]).alias("spans"))


def _sql_pattern(r: Rule) -> str:
    return r.pattern.replace("'", "''")


def _sql_spans(r: Rule) -> str:
    p = _sql_pattern(r)
    body = f"regexp_extract_all(t, '{p}', {r.group})"
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: struct_pack(
      s := CAST(list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i - 1], lambda h: length(h))), 0) AS BIGINT),
      n := CAST(length(regexp_extract_all(t, '{p}')[i]) AS BIGINT), b := length({body}[i]))), lambda x: x.b >= {r.least})"""


def _sql_text(rules: list[Rule]) -> str:
    every = "list_sort(" + " || ".join(f"list_transform({r.name}_, lambda x: struct_pack(s := x.s, k := {i}, e := x.s + x.n, name := '{r.name}'))" for i, r in enumerate(rules)) + ")"
    return f"coalesce(array_to_string(list_transform({every}, lambda x: x.name || ':' || x.s || ':' || x.e), ','), '')"


BASE = [r for r in RULES if r.base]
SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {', '.join(f'{_sql_spans(r)} AS {r.name}_' for r in RULES)} FROM d)
SELECT doc_id, {', '.join(f'CAST(len({r.name}_) AS BIGINT) AS n_{r.name}' for r in BASE)}, sha256({_sql_text(BASE)}) AS base_sha256, {_sql_text(list(RULES))} AS spans FROM f"""
