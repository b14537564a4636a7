"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names literal tokens that each URL it fits must hold. Counts of the tokens over all URLs tell which of a
rule's tokens is rarest; the rule is filed under that one. The tokens of a URL fetch the rules filed under them, and only
these candidates' regular expressions run. Rules without a literal token are candidates of every URL.

Two kinds of rules share the index. A host rule (host, path prefix, verdict) fits its host and all subdomains where the
URL's path starts with its path; the longest wins (length of host + path, then text order, and block before allow).
A pattern rule (name, regular expression, literals, verdict) holds where no host rule fits: block wins over allow.
A URL that no rule fits has the default verdict.

Defined cases. Null URL, or one without "://": host, path and rule are as for an empty URL; the default verdict holds.
Repeated rows: a row each. Empty table: no rows. Extra columns stay unread. Very long URLs are handled whole.
Everything runs as DataFrame expressions; the rules are a table given by the caller and bounded by MAX_RULES.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 100_000
_TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str  # Java regular expression, searched in the lower-cased URL, or in host + path for host rules
    literals: tuple[str, ...]
    kind: str = "pattern"
    rank: int = 0  # host rules: length of host + path


def host_rule(verdict: str, host: str, path: str) -> Rule:
    quoted = "".join(c if re.match(r"[\w/-]", c) else "\\" + c for c in host)
    literals = re.findall(_TOKEN, host.lower())
    # of the path, only tokens that end before its end are whole tokens of the URL; the last may go on
    literals += re.findall(_TOKEN + r"(?=[^a-z0-9])", path.lower()) if path.isascii() else []
    return Rule(host + path, verdict, rf"^(?:.*\.)?{quoted}\|" + "".join(c if re.match(r"[\w/-]", c) else "\\" + c for c in path), tuple(literals), "host", len(host) + len(path))


def pattern_rule(name: str, verdict: str, pattern: str, *literals: str) -> Rule:
    return Rule(name, verdict, pattern, tuple(literals))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rarest_literals(spark, urls: DataFrame, rules: list[Rule]) -> dict[str, str]:
    """For each rule that has literals, the one that the fewest URLs hold (ties: the longer, then text order)."""
    wanted = sorted({t for r in rules for t in r.literals})
    counted = (
        urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col("_low"), F.lit(f"({_TOKEN})"), F.lit(1)))).alias("t"))
        .where(F.col("t").isin(wanted)).groupBy("t").agg(F.count("*").alias("n")).collect()
    )  # at most a row for each literal of a rule
    n = {r["t"]: r["n"] for r in counted}
    return {r.name: min(r.literals, key=lambda t: (n.get(t, 0), -len(t), t)) for r in rules if r.literals}


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row: id, host, path, rule (the host rule that won, else null), pattern (the pattern rule that decided, else null), verdict, n_candidates."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the index is bounded to {MAX_RULES}")
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("two rules have the same name")
    spark = pages.sparkSession
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url")).select(id_col, host.alias("host"), path.alias("path"), lower_ascii(F.coalesce("_url", F.lit(""))).alias("_low"))
    under = rarest_literals(spark, rows, rules)
    filed: dict[str, list[Rule]] = {}
    for r in rules:
        filed.setdefault(under.get(r.name, ""), []).append(r)
    table = spark.createDataFrame(
        [(t, [(r.kind == "host", -r.rank, r.verdict != "block", r.name, r.verdict, r.pattern) for r in rs]) for t, rs in filed.items()],
        "t string, rules array<struct<host:boolean,rank:int,soft:boolean,name:string,verdict:string,pattern:string>>",
    )
    # "" stands for rules without a literal: every URL fetches it
    tokens = F.array_distinct(F.array_union(F.array(F.lit("")), F.regexp_extract_all(F.col("_low"), F.lit(f"({_TOKEN})"), F.lit(1))))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    wanted = F.array(*[F.lit(t) for t in sorted(filed)]) if filed else F.array().cast("array<string>")
    fetched = rows.withColumn("_t", F.explode_outer(F.array_intersect(tokens, wanted)))
    joined = fetched.join(F.broadcast(table.withColumnRenamed("t", "_t")), "_t", "left")  # bounded by MAX_RULES
    subject = lambda r: F.when(r["host"], F.concat_ws("|", "host", "path")).otherwise(F.col("_low"))
    hits = F.filter("rules", lambda r: F.regexp(subject(r), r["pattern"]))
    best = lambda h, kind: F.array_min(F.transform(F.filter(h, lambda r: r["host"] == F.lit(kind)), lambda r: F.struct(r["rank"].alias("rank"), r["soft"].alias("soft"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    scored = joined.withColumn("_hits", hits).select(id_col, "_row", "host", "path", F.coalesce(F.size("rules"), F.lit(0)).alias("_n"), best(F.col("_hits"), True).alias("_own"), best(F.col("_hits"), False).alias("_pat"))
    return (
        scored.groupBy("_row", id_col, "host", "path").agg(F.min("_own").alias("_own"), F.min("_pat").alias("_pat"), F.sum(F.greatest("_n", F.lit(0))).cast("int").alias("n_candidates"))
        .select(
            id_col, "host", "path", F.col("_own.name").alias("rule"), F.when(F.col("_own").isNull(), F.col("_pat.name")).alias("pattern"),
            F.coalesce("_own.verdict", "_pat.verdict", F.lit(default)).alias("verdict"), "n_candidates",
        )
    )


#: The rules of the query.
HOST_RULES = [
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
]
PATTERN_RULES = [
    pattern_rule("spam farm", "block", r"://([^/?#]*\.)?spam-farm\.", "spam", "farm"),
    pattern_rule("cheap pills", "block", r"://([^/?#]*\.)?cheap-pills\.", "cheap", "pills"),
    pattern_rule("casino", "block", r"://[^/?#]*\bcasino\b", "casino"),
    pattern_rule("adult", "block", r"://[^/?#]*\badult\b", "adult"),
    pattern_rule("feed tracking", "allow", r"[?&]utm_source=feed\b", "utm", "source", "feed"),
]
