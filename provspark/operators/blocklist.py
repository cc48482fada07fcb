"""Pattern block lists: parsing the list and finding the URLs on it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.functions import texts as X

# Globs with a plain host ("*://*.host/*" or "*://host/*") are looked up by host, others by a text that all their matches
# contain. One automaton of such texts holds so many characters at most; a longer list takes several.
AUTOMATON_CHARS = 16_000_000
_HOST_GLOB = r"^\*://(?:\*\.)?([a-z0-9\-]+(?:\.[a-z0-9\-]+)+)/\*$"


def parse(lines: DataFrame) -> DataFrame:
    """``(kind, pattern, ignore_case)`` of list lines ``(line)``: globs start with ``*``, regexes with ``/``."""
    stripped = lines.withColumn("line", X.strip(F.col("line")))
    line = F.col("line")
    body = F.when(line.endswith("/i"), F.expr("substring(line, 2, length(line) - 3)")).when(
        line.endswith("/") & (F.length(line) > 1), F.expr("substring(line, 2, length(line) - 2)")
    ).otherwise(F.expr("substring(line, 2)"))
    parsed = stripped.select(
        *[c for c in lines.columns if c != "line"],
        F.when(line.startswith("*"), "glob").when(line.startswith("/") & (body != ""), "regex").alias("kind"),
        F.when(line.startswith("*"), line).otherwise(body).alias("pattern"),
        (line.startswith("/") & line.endswith("/i")).alias("ignore_case"),
    )
    return parsed.filter("kind is not null")


def valid_only(patterns: DataFrame) -> DataFrame:
    """Drop regexes that do not compile. Spark cannot test that in a column, so an Arrow batch function does."""

    # Local, so that it travels to the workers by value and they need not import this package.
    @F.pandas_udf("boolean")
    def compiles(pattern: pd.Series) -> pd.Series:
        def ok(p: str) -> bool:
            try:
                re.compile(p)
                return True
            except re.error:
                return False

        return pattern.map(ok)

    globs = patterns.filter("kind = 'glob'")
    return globs.unionByName(patterns.filter("kind = 'regex'").filter(compiles(F.col("pattern"))))


def compiled(patterns: DataFrame) -> DataFrame:
    """Distinct matchers ``(kind, pattern, ignore_case)``; a subdomain glob also yields its form for the bare domain."""
    globs = patterns.filter("kind = 'glob'").select("pattern")
    apex = globs.filter(F.col("pattern").contains("*://*.")).select(
        F.concat(
            F.substring_index("pattern", "*://*.", 1), F.lit("*://"),
            F.expr("substring(pattern, instr(pattern, '*://*.') + 6)"),
        ).alias("pattern")
    )
    as_globs = globs.union(apex).select(F.lit("glob").alias("kind"), "pattern", F.lit(False).alias("ignore_case"))
    return as_globs.union(patterns.filter("kind = 'regex'").select("kind", "pattern", "ignore_case")).distinct()


def blocklist_join(urls: DataFrame, patterns: DataFrame, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Rows of ``urls(url, ...)`` matched by at least one pattern (semi join). The same steps serve a list of any size.

    Plain domain globs, the bulk of such lists, are found by an equi-join on the text before a slash and its suffixes
    after a dot. Of every other pattern a literal that all its matches contain goes into an Aho-Corasick automaton. One
    pass of the automaton over a URL finds the patterns that may match, and only these are tried, with Python's ``re``;
    patterns without a literal are tried on every URL. The list is counted first and cut into as many automata as keep
    each within ``automaton_chars``; each is sent to the tasks, and all read the distinct URLs in one pass.
    """
    host = F.regexp_extract("pattern", _HOST_GLOB, 1)
    is_host = (F.col("kind") == "glob") & (host != "")
    hosts = patterns.filter(is_host).select(
        host.alias("host"), F.col("pattern").startswith("*://*.").alias("sub")
    ).distinct()

    distinct = urls.select("url").filter("url <> ''").distinct()
    # "*://*.h/*": some text ending in ".h" (or "://h") stands before a "/" after a "://"; "*://h/*": exactly "://h/".
    by_host = _host_tokens(distinct).join(hosts, "host").filter(F.col("sub") | F.col("whole")).select("url")
    rest = with_literals(compiled(patterns.filter(~is_host)))
    return urls.join(by_host.union(_by_automata(distinct, rest, automaton_chars)), "url", "left_semi")


def _literal_finder():
    # Local, so that it travels to the workers by value and they need not import this package.
    def literal_of(kind: str, pattern: str, ignore_case: bool) -> str:
        """The longest text, lower-cased, that each match of a matcher must contain; empty if there is none.

        Lower-casing may change lengths or depend on what stands around, so only ASCII counts; under ignore-case without the
        letters that some other character folds to. A glob's texts stand between ``*``, ``?`` and ``[...]``, a regex's at the top
        level of its parsed form.
        """
        runs, run = [""], ""
        if kind == "glob":
            i = 0
            while i < len(pattern):
                c = pattern[i]
                i += 1
                if c == "[":
                    # The first character of a set may be "]" itself; without an end, "[" stands for itself.
                    start = i + 1 if pattern[i:i + 1] == "!" else i
                    end = pattern.find("]", start + 1)
                    if end >= 0:
                        c, i = "*", end + 1
                if c in "*?":
                    runs.append(run)
                    run = ""
                else:
                    run += c
            runs.append(run)
        else:
            from re import _parser

            try:
                parsed = _parser.parse(pattern, re.IGNORECASE if ignore_case else 0)
            except re.error:  # the planner may ask before invalid patterns are dropped
                return ""
            fold = ignore_case or bool(parsed.state.flags & re.IGNORECASE)

            def walk(items) -> None:
                nonlocal run
                for op, value in items:
                    name = str(op)
                    if name == "LITERAL" and not (fold and (value > 127 or chr(value).lower() in "ksi")):
                        run += chr(value)
                    elif name == "SUBPATTERN" and not (value[1] & re.IGNORECASE):
                        walk(value[3])
                    elif name != "AT":
                        runs.append(run)
                        run = ""

            walk(parsed)
            runs.append(run)
        return max((t for r in runs for t in re.split(r"[^\x00-\x7f]+", r)), key=len).lower()

    return literal_of


literal_of = _literal_finder()


def with_literals(matchers: DataFrame) -> DataFrame:
    """Matchers with their ``literal``."""
    find = literal_of

    @F.pandas_udf("string")
    def literals(kind: pd.Series, pattern: pd.Series, ignore_case: pd.Series) -> pd.Series:
        return pd.Series([find(*row) for row in zip(kind, pattern, ignore_case)], dtype=object)

    return matchers.withColumn("literal", literals("kind", "pattern", "ignore_case"))


def _by_automata(urls: DataFrame, matchers: DataFrame, chars: int) -> DataFrame:
    """URLs that one of ``matchers(kind, pattern, ignore_case, literal)`` matches."""
    size = F.length("pattern") + F.length("literal") + 16
    total = matchers.agg(F.sum(size)).first()[0] or 0
    shards = -(-total // chars)
    spark = urls.sparkSession
    found = urls.limit(0)
    for shard in range(shards):
        rows = matchers.filter(F.pmod(F.xxhash64("kind", "pattern", "ignore_case"), F.lit(shards)) == shard).toArrow()
        listed = spark.sparkContext.broadcast([tuple(r.values()) for r in rows.to_pylist()])
        hit = urls.filter(_on_list(listed)("url"))
        found = found.union(hit) if shard else hit
    return found


def _on_list(listed):
    """Column function: whether one of the broadcast matchers matches a URL."""
    @F.pandas_udf("boolean")
    def on_list(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import fnmatch
        from functools import lru_cache

        import ahocorasick

        lower = {i: i + 32 for i in range(65, 91)}
        automaton, always, by_literal = ahocorasick.Automaton(), [], {}
        for kind, pattern, fold, literal in listed.value:
            (by_literal.setdefault(literal, []) if literal else always).append((kind, pattern, fold))
        for literal, tried in by_literal.items():
            automaton.add_word(literal, tried)
        automaton.make_automaton()

        @lru_cache(maxsize=65_536)
        def test(k: str, p: str, fold: bool):
            try:
                return re.compile(fnmatch.translate(p)).match if k == "glob" else re.compile(p, re.IGNORECASE if fold else 0).search
            except re.error:  # the planner may ask before invalid patterns are dropped
                return lambda u: None

        def matched(url: str) -> bool:
            if any(test(*m)(url) for m in always):
                return True
            seen = set()
            for _, tried in automaton.iter(url.translate(lower)) if by_literal else ():
                if id(tried) not in seen:
                    seen.add(id(tried))
                    if any(test(*m)(url) for m in tried):
                        return True
            return False

        for urls in batches:
            yield urls.map(matched, na_action="ignore").fillna(False).astype(bool)

    return on_list


def _host_tokens(urls: DataFrame) -> DataFrame:
    """Hosts a URL may be listed under as ``(url, host, whole)``.

    These are, for each slash after the first ``://``, the suffixes after a dot of the text before it; ``whole`` marks
    a full text that stands right behind a ``://``.
    """
    split = urls.filter(F.instr("url", "://") > 0).select(
        "url", F.split(F.expr("substring(url, instr(url, '://') + 3)"), "/").alias("parts")
    )
    pieces = split.select("url", "parts", F.posexplode("parts").alias("i", "piece")).filter(F.col("i") < F.size("parts") - 1)
    before, earlier = F.get("parts", F.col("i") - 1), F.get("parts", F.col("i") - 2)
    starts = (F.col("i") == 0) | ((before == "") & earlier.endswith(":"))
    labels = pieces.select("url", F.coalesce(starts, F.lit(False)).alias("starts"), F.split("piece", r"\.").alias("labels"))
    cut = labels.select("url", "starts", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("k"))
    host = F.array_join(F.slice("labels", F.col("k"), F.size("labels")), ".")
    return cut.filter(F.col("starts") | (F.col("k") > 1)).select(
        "url", host.alias("host"), (F.col("starts") & (F.col("k") == 1)).alias("whole")
    )
