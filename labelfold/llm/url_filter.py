"""URL filter: pattern rules indexed by their rarest literal token (operator 9, native).

A pattern rule is a wildcard pattern over ``host + path + rest`` of a URL: ``*``
is any run of characters, ``^`` a separator or either end, all else literal.  A
site rule ``host/path`` fits the host and its subdomains where the path starts
with the rule's.  Every rule is turned into one regular expression and indexed
under one whole token ``[a-z0-9]+`` that any matching URL must hold: the one
that the fewest URLs of the input hold.  A rule without such a token sits under
the empty token, which every URL fetches.  Each URL looks up its distinct tokens
and runs only the regular expressions fetched.  No row is shuffled but for one
count per rule token.

Cases: a null URL, or one without ``://``, has empty host and path, matches no
rule and is allowed; repeated rows and ids are judged one by one; extra columns
pass through unless they bear an output's name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Rules are a parameter of the job, not data: their index travels as one literal of the plan.
MAX_RULES = 20_000

SITE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Default patterns: gambling, adult and tracker hosts, executable downloads, session and print copies of pages.
PATTERN_RULES = (
    ("^casino^", "block"), ("^poker^", "block"), ("^betting^", "block"), ("^slots^", "block"), ("^porn^", "block"),
    ("^xxx^", "block"), ("^adult^", "block"), ("^malware^", "block"), ("^phishing^", "block"), ("^warez^", "block"),
    ("^torrent^", "block"), ("^adserver^", "block"), ("^doubleclick^", "block"), ("^tracker^", "block"),
    ("^wp-login.php^", "block"), ("^cgi-bin^", "block"), ("*.exe^", "block"), ("*.apk^", "block"),
    ("^phpsessid=*", "block"), ("^jsessionid=*", "block"), ("^print=1^", "block"),
)


def site_regex(rule: str) -> str:
    """Regular expression of a site rule over ``host + path``."""
    host, _, path = rule.partition("/")
    return r"^(?:[^/]*\.)?" + re.escape(host) + re.escape("/" + path)


def pattern_regex(pattern: str) -> str:
    """Regular expression of a wildcard pattern over the lower-cased URL behind ``://``."""
    return "".join("(?s:.*)" if c == "*" else "(?:^|[^a-z0-9]|$)" if c == "^" else re.escape(c) for c in pattern.lower())


def literal_tokens(rule: str, site: bool) -> list[str]:
    """Whole tokens that every matching URL must hold."""
    if site:  # the last path token may go on in the URL
        host, _, path = rule.partition("/")
        inner = path if path.endswith("/") or not path else path.rpartition("/")[0]
        return sorted(set(re.findall(r"[a-z0-9]+", host.lower())) | set(re.findall(r"[a-z0-9]+", inner.lower())))
    closed = "\x00" + rule.lower() + "\x00"  # a token at an open end or next to * may go on in the URL
    return sorted({m[1] for m in re.finditer(r"(?<![a-z0-9*\x00])([a-z0-9]+)(?![a-z0-9*\x00])", closed)})


def url_parts(url: Column) -> dict[str, Column]:
    """``host``, ``path`` and ``rest`` (from the end of the path) of a URL."""
    behind = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.regexp_extract(behind, r"^[^/?#]*", 0)
    tail = F.expr("substring(behind, length(raw_host) + 1)")
    return {"behind": behind, "raw_host": host, "tail": tail}


def _compiled(site_rules, pattern_rules) -> list[dict]:
    rules = [{"rule": r, "verdict": v, "regex": site_regex(r), "site": True, "tokens": literal_tokens(r, True)}
             for r, v in site_rules]
    rules += [{"rule": r, "verdict": v, "regex": pattern_regex(r), "site": False, "tokens": literal_tokens(r, False)}
              for r, v in pattern_rules]
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the index takes at most {MAX_RULES}")
    return rules


def rule_index(urls: DataFrame, rules: list[dict]) -> dict[str, list[dict]]:
    """Rules by their rarest token, by the number of rows of ``urls(tokens)`` that hold it (one bounded count)."""
    wanted = sorted({t for r in rules for t in r["tokens"]})
    seen = {}
    if wanted:
        rows = (urls.select(F.explode(F.array_intersect("tokens", F.lit(wanted))).alias("t"))
                .groupBy("t").count().collect())  # at most one row per rule token
        seen = {r["t"]: r["count"] for r in rows}
    index: dict[str, list[dict]] = {}
    for r in rules:
        key = min(r["tokens"], key=lambda t: (seen.get(t, 0), t), default="")
        index.setdefault(key, []).append({k: r[k] for k in ("rule", "verdict", "regex", "site")})
    return index


def judge(pages: DataFrame, site_rules: Sequence = SITE_RULES, pattern_rules: Sequence = PATTERN_RULES) -> DataFrame:
    """Judge every row's ``url``: adds ``host, path, rule, verdict, pattern_rule, n_candidates``.

    ``rule`` is the longest fitting site rule (the first by name of equally long
    ones), else null.  ``verdict`` is that rule's; else ``block`` if a blocking
    pattern fits and no longer allowing one does; else ``allow``.
    """
    added = ("host", "path", "rule", "verdict", "pattern_rule", "n_candidates")
    kept = [c for c in pages.columns if c.lower() not in added]
    rules = _compiled(site_rules, pattern_rules)
    parts = url_parts(F.col("url"))
    df = pages.select(*[F.col(f"`{c}`") for c in kept])
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("page")
    df = df.select(row, F.col("url")).withColumn("behind", parts["behind"])
    df = df.withColumn("raw_host", parts["raw_host"]).withColumn("tail", parts["tail"])
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = df.select("page", lower(F.col("raw_host")).alias("host"),
                   F.regexp_extract("tail", r"^[^?#]*", 0).alias("path"), lower(F.col("behind")).alias("address"))
    df = df.withColumn("tokens", F.array_distinct(F.regexp_extract_all("address", F.lit("([a-z0-9]+)"), F.lit(1))))
    index = rule_index(df, rules)
    held = F.from_json(F.lit(json.dumps(index)),
                       "map<string, array<struct<rule:string, verdict:string, regex:string, site:boolean>>>")
    df = df.withColumn("index", held)
    fetched = F.flatten(F.transform(F.concat(F.array(F.lit("")), F.filter("tokens", lambda t: F.map_contains_key("index", t))),
                                    lambda t: F.coalesce(F.try_element_at("index", t), F.expr(
                                        "cast(array() as array<struct<rule:string, verdict:string, regex:string, site:boolean>>)"))))
    df = df.select("page", "host", "path", "address", fetched.alias("found"))
    site = F.concat("host", "path")
    fits = F.filter("found", lambda r: F.when(r["site"], F.regexp_like(site, r["regex"])).otherwise(
        F.regexp_like(F.col("address"), r["regex"])))
    df = df.select("page", "host", "path", F.size("found").alias("n_candidates"), fits.alias("fits"))
    # longest first, then by name: order by (-length, rule)
    longest = lambda kind: F.array_min(F.transform(F.filter("fits", lambda r: r["site"] == kind), lambda r: F.struct(
        (-F.length(r["rule"])).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    df = df.withColumn("s", longest(F.lit(True))).withColumn("p", longest(F.lit(False)))
    return df.select(*[F.col("page").getField(c).alias(c) for c in kept], "host", "path", F.col("s.rule").alias("rule"),
                     F.coalesce("s.verdict", "p.verdict", F.lit("allow")).alias("verdict"),
                     F.col("p.rule").alias("pattern_rule"), "n_candidates")


def query(spark, sf_dir: str) -> DataFrame:
    """``op9_url_filter``: the verdict of every page."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def oracle_sql() -> str:
    """The same verdicts in DuckDB, with every rule tried on every URL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    by_length = sorted(SITE_RULES, key=lambda r: (-len(r[0]), r[0]))
    patterns = sorted(PATTERN_RULES, key=lambda r: (-len(r[0]), r[0]))
    case = lambda rules, text, regex, out: "CASE " + " ".join(
        f"WHEN regexp_matches({text}, {q(regex(r))}) THEN {q(out(r, v))}" for r, v in rules) + " END"
    ascii_lower = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS behind
           FROM pages),
b AS (SELECT page_id, behind, regexp_extract(behind, '^[^/?#]*') AS raw_host FROM a),
c AS (SELECT page_id, {ascii_lower('raw_host')} AS host,
             regexp_extract(substr(behind, length(raw_host) + 1), '^[^?#]*') AS path,
             {ascii_lower('behind')} AS address FROM b),
d AS (SELECT page_id, host, path,
             {case(by_length, 'host || path', site_regex, lambda r, v: r)} AS rule,
             {case(by_length, 'host || path', site_regex, lambda r, v: v)} AS sv,
             {case(patterns, 'address', pattern_regex, lambda r, v: v)} AS pv FROM c)
SELECT page_id, host, path, rule, coalesce(sv, pv, 'allow') AS verdict FROM d"""
