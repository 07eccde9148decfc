"""URL filters: host rules, and pattern rules that are looked up by their rarest token.

Host rules (verdict, host, path) fit a host, all its subdomains and the paths that begin with theirs; the
longest wins. They are a list in the call, compiled into one expression.

Pattern rules are regular expressions on the lower-case URL. A run of letters and digits that stands
between other characters in the expression must be a token of every URL that it matches. Each rule is
indexed by that one of its tokens which the fewest URLs have. The index is a small literal map from tokens to
rules: the tokens of a URL fetch its candidate rules, and only those run. Rules without such a token run on
every URL.

Scale: the rules' tokens are counted over all URLs (partial counts of as many tokens as the rules have are all that
is shuffled); judging is then a projection of each row, without a join.

Defined results: null and URLs without `://` have empty host and path, no rule, and the patterns' verdict
on what there is (null: allow); repeated rows each get a row; an empty table gives no rows; other columns
are ignored; URLs are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.patterns import read

HOST_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: What to keep out where no host rule speaks: link farms, shops of doubtful goods, accounts, carts, trackers, files that aren't pages.
PATTERNS = (
    r"//([^/]*\.)?spam-farm\.",
    r"//([^/]*\.)?link-farm\.",
    r"//([^/]*\.)?(casino|poker)[^/.]*\.",
    r"[/.-]casino[/.-]",
    r"[/.-]porn[/.-]",
    r"[/.-]pharmacy[/.-]",
    r"[/?&]sessionid=",
    r"[?&]phpsessid=",
    r"/wp-login\.php",
    r"/cart/checkout[/?]",
    r"/account/login[/?]",
    r"/cgi-bin/",
    r"/tag/[^/]+/page/[0-9]+",
    r"\.(exe|zip|iso|dmg)$",
    r"//[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}[:/]",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _low(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = HOST_RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    best = None
    for verdict, own, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        said = F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, said) if best is None else best.when(fits, said)
    return best if best is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens_of(pattern: str) -> list[str]:
    """The tokens that every URL which the pattern matches must have."""
    alternatives = read(pattern)
    parts: list[str | None] = []  # of each piece its literal, "" for what parts tokens, None for what may be part of one
    for piece in alternatives[0] if len(alternatives) == 1 else ():
        once = (piece.least, piece.most) == (1, 1)
        if piece.edge or once and piece.chars and not any(c.isalnum() for c in piece.chars):
            parts.append("")
        else:
            parts.append(*piece.chars) if once and piece.chars and len(piece.chars) == 1 else parts.append(None)
    out, run = [], None
    for x in [*parts, None]:
        if x == "":
            out += [run] if run else []
            run = ""
        else:
            run = None if x is None or run is None else run + x
    return out


def tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(_low(url), "[^a-z0-9]+"), lambda x: x != ""))


def rarest(urls: DataFrame, patterns: tuple[str, ...] = PATTERNS) -> dict[str, list[int]]:
    """Each rule's number under the one of its tokens that the fewest rows of `urls` have (equal ones: the first by code point)."""
    own = {k: tokens_of(p) for k, p in enumerate(patterns)}
    asked = sorted({t for x in own.values() for t in x})
    if not asked:
        return {}
    met = urls.where("url is not null").select(F.explode(F.filter(tokens(F.col("url")), lambda t: t.isin(asked))).alias("token"))
    seen = {r["token"]: r["n"] for r in met.groupBy("token").agg(F.count("*").alias("n")).collect()}  # as many as the rules have tokens
    out: dict[str, list[int]] = {}
    for k, x in own.items():
        if x:
            out.setdefault(min(x, key=lambda t: (seen.get(t, 0), t)), []).append(k)
    return out


def matched(url: Column, index: dict[str, list[int]], patterns: tuple[str, ...] = PATTERNS) -> Column:
    """Does a pattern match: those that the URL's tokens fetch from the index, and those that aren't in it."""

    def runs(low: Column, fetched: Column) -> Column:
        out = F.lit(False)
        held = {k for own in index.values() for k in own}
        for k, p in enumerate(patterns):
            out = out | (F.array_contains(fetched, k) & low.rlike(p) if k in held else low.rlike(p))
        return out

    by_token = F.create_map(*(x for t, own in index.items() for x in (F.lit(t), F.array(*map(F.lit, own))))) if index else F.create_map().cast("map<string,array<int>>")
    fetched = F.flatten(F.filter(F.transform(tokens(url), lambda t: F.try_element_at(by_token, t)), lambda x: x.isNotNull()))
    row = F.array(F.struct(_low(url).alias("low"), fetched.alias("rules")))
    return F.coalesce(F.exists(row, lambda r: runs(r["low"], r["rules"])), F.lit(False))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = HOST_RULES, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """page_id, host, path, rule (the host rule that fits, or null) and verdict of every row."""
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("by_host", host_rule(F.col("host"), F.col("path"), rules))
    by_pattern = F.when(F.col("by_host").isNull(), F.when(matched(F.col("url"), rarest(pages, patterns), patterns), "block").otherwise("allow"))
    return own.select("page_id", "host", "path", F.col("by_host.rule").alias("rule"), F.coalesce("by_host.verdict", by_pattern).alias("verdict"))


def oracle(rules: tuple[tuple[str, str, str], ...] = HOST_RULES, patterns: tuple[str, ...] = PATTERNS) -> str:
    """The result of judge() in DuckDB SQL."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in ordered]
    rule = " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits)
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)
    low = f"translate(url, '{UPPER}', '{LOWER}')"
    hit = " OR ".join(f"regexp_matches({low}, '{p}')" for p in patterns)
    return f"""
WITH r AS (SELECT page_id, url, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
  h AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {hit} THEN 'block' ELSE 'allow' END AS verdict FROM h
"""
