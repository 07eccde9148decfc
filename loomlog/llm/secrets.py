"""Secret scans with a trigram inverted index, in DataFrame operations only.

1. Each rule's regular expression is read once on the driver into a Boolean query over trigrams that any
   match must hold (lower case): an AND of ORs of ANDs. A rule without mandatory trigrams has no query.
2. Postings: of each document the query trigrams that it holds, gathered per trigram and bucket of
   documents into a list of document keys. Buckets follow the number of documents, so no list grows with
   the corpus, however common a trigram is.
3. Each rule's query is answered on the postings of a bucket by intersecting and uniting lists. What comes
   out is a small table of candidates.
4. Candidates meet their texts again, and only there the rules' expressions run. Rules without a query run
   on every text. The postings' lengths tell each trigram's frequency: a text without the rarest trigram of
   any alternative can't be a candidate and is left out before the join, so only such texts are moved.

Spans are code points, end exclusive. They come from the texts between matches (split) and the matches
themselves, whose lengths, added up in rows of `ROOT`, tell where each match lies.

Defined results: a null text is empty and has no spans; documents are told apart by hashes of doc_id and text,
so rows that share a doc_id, or have none, are verified each on its own text; an empty table gives no rows; other
columns are ignored by scan() and kept by redact() whatever their names; texts are scanned whole, and work on a
text grows with its length and its number of matches, not with their product.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.patterns import Piece, read
from loomlog.llm.shared import fresh, materialize


@dataclass(frozen=True)
class Rule:
    """`pattern` is what Spark's (Java's) expressions understand; `group` must have `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules. access and hex need their length in the expression itself: a run that is too short has no
#: longer one inside it, so this finds the same matches as a filter would.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Rules beyond the base ones: key blocks and well-known token forms.
MORE = (
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + MORE
#: Documents of a bucket of postings, about.
BUCKET_ROWS = 4096
#: Items of a long array that are added up, or cut from a text, at once.
ROOT = 256
SPANS = "array<struct<start:bigint,rule:int,end:bigint>>"


def _exact(piece: Piece) -> list[str] | None:
    """All strings that a piece matches, if they are a few."""
    if piece.options:
        own = [_product(x) for x in piece.options]
        out = None if None in own else [x for y in own for x in y]
    else:
        out = sorted(piece.chars) if piece.chars and len(piece.chars) <= 8 else None
    if out is None or (piece.least, piece.most) == (1, 1):
        return out
    return [*out, ""] if (piece.least, piece.most) == (0, 1) else None


def _product(pieces: tuple[Piece, ...]) -> list[str] | None:
    out = [""]
    for piece in pieces:
        own = _exact(piece)
        if own is None or len(out) * len(own) > 64:
            return None
        out = [a + b for a, b in product(out, own)]
    return out


def _strings(pieces: tuple[Piece, ...]) -> list[list[str]]:
    """The literal runs that every match has, each as its alternatives."""
    runs: list[list[str]] = [[""]]
    for piece in pieces:
        own = _exact(piece)
        if own is not None and len(runs[-1]) * len(own) <= 64:
            runs[-1] = [a + b for a, b in product(runs[-1], own)]
            continue
        if piece.least and (piece.least, piece.most) != (1, 1):  # once at least
            runs += [[""], *_strings((replace(piece, least=1, most=1),))]
        elif len(piece.options) == 1:
            runs += _strings(piece.options[0])
        runs.append([""])
    return runs


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """AND over runs of OR over alternatives of AND over trigrams; empty: no mandatory trigrams."""
    alternatives = read(pattern)
    out = []
    for run in _strings(alternatives[0] if len(alternatives) == 1 else (Piece(options=alternatives),)):
        options = [sorted({x.lower()[k : k + 3] for k in range(len(x) - 2)}) for x in run]
        if all(options):  # an option that asks for more than another one adds nothing
            out.append([x for k, x in enumerate(options) if not any(set(y) < set(x) or y == x and j < k for j, y in enumerate(options))])
    return out


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x made once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _in_rows(x: Column, f: Callable[[Column], Column]) -> Column:
    """An array as an array of rows of `ROOT` items, each changed by `f`."""
    numbers = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.floor((F.size(x) - 1) / ROOT).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: f(F.slice(x, k * ROOT + 1, F.lit(ROOT))))


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """The running sums (or whatever `both` makes of two) of an array of bigint."""

    def plain(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<bigint>"), lambda acc, v: F.concat(acc, F.array(F.coalesce(both(F.get(acc, F.size(acc) - 1), v), v))))

    def joined(rows: Column) -> Column:
        ends = plain(F.transform(rows, lambda r: F.element_at(r, -1)))
        return _bound(ends, lambda e: F.flatten(F.transform(rows, lambda r, k: _bound(F.get(e, k - 1), lambda last: F.transform(r, lambda v: F.coalesce(both(last, v), v))))))

    return _bound(_in_rows(values, plain), joined)


def _lengths(x: Column) -> Column:
    return F.transform(x, lambda t: F.length(t).cast("bigint"))


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's leftmost matches that don't overlap."""
    whole = _lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))

    def laid(hits: Column) -> Column:
        own = _lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))) if rule.group else hits
        gaps = _lengths(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits)))
        ends = running(F.zip_with(gaps, hits, lambda a, b: a + b), lambda a, b: a + b)
        kept = F.filter(F.arrays_zip(ends.alias("end"), hits.alias("hit"), own.alias("own")), lambda x: x["own"] >= rule.least)
        return F.transform(kept, lambda x: F.struct((x["end"] - x["hit"]).alias("start"), x["end"].alias("end")))

    return F.when(text.rlike(rule.pattern), _bound(whole, laid)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def _tagged(text: Column, rule: Rule, number: int) -> Column:
    return F.transform(spans(text, rule), lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("rule"), x["end"].alias("end")))


def _keys() -> list[Column]:
    """What tells documents apart: hashes of (doc_id, text) and of the text."""
    return [F.xxhash64("doc_id", "text").alias("sec_key"), F.xxhash64("text").alias("sec_text")]


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, Callable[[Column], Column]]:
    """(key, asked): the documents whose postings answer rules' trigram queries, and those rules' numbers. With it a
    test of texts that every candidate passes: it holds the rarest trigram of an alternative of each run of a rule."""
    queries = {k: q for k, x in enumerate(rules) if (q := trigram_query(x.pattern))}
    grams = sorted({g for q in queries.values() for run in q for option in run for g in option})
    low = docs.select(_keys()[0].alias("key"), F.lower("text").alias("low"))  # lowered once, not for each trigram
    held = low.select("key", F.array_compact(F.array(*(F.when(F.col("low").contains(g), F.lit(g)) for g in grams))).alias("grams"))
    buckets = max(1, -(-docs.count() // bucket_rows))
    dealt = held.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "key", F.explode_outer("grams").alias("gram")).where("gram is not null")  # explode() would have Spark make `grams` twice
    postings = materialize(dealt.groupBy("bucket", "gram").agg(F.collect_set("key").alias("keys")), "postings")
    often = {r["gram"]: r["n"] for r in postings.groupBy("gram").agg(F.sum(F.size("keys")).alias("n")).collect()}  # as many as the rules have trigrams
    held_in = postings.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("post"))
    none = F.array().cast("array<bigint>")

    def posting(gram: str) -> Column:
        return F.coalesce(F.try_element_at("post", F.lit(gram)), none)

    def answered(query: list[list[list[str]]]) -> Column:
        both = None
        for run in query:
            either = None
            for option in run:
                all_ = posting(option[0])
                for gram in option[1:]:
                    all_ = F.array_intersect(all_, posting(gram))
                either = all_ if either is None else F.array_union(either, all_)
            both = either if both is None else F.array_intersect(both, either)
        return both

    def told(k: int) -> Column:
        return F.transform(answered(queries[k]), lambda key: F.struct(key.alias("key"), F.lit(k).alias("rule")))

    def may(text: Column) -> Column:
        def one(low: Column) -> Column:
            out = F.lit(False)
            for query in queries.values():
                every = F.lit(True)
                for run in query:
                    some = F.lit(False)
                    for gram in sorted({min(option, key=lambda g: (often.get(g, 0), g)) for option in run}):
                        some = some | low.contains(gram)
                    every = every & some
                out = out | every
            return out

        return F.exists(F.array(F.lower(text)), one)

    told_all = F.concat(*map(told, queries)) if queries else F.array().cast("array<struct<key:bigint,rule:int>>")
    out = held_in.select(F.explode(told_all).alias("x")).groupBy(F.col("x.key").alias("key")).agg(F.collect_set("x.rule").alias("asked"))
    return materialize(out, "candidates"), may


def _found(docs: DataFrame, rules: tuple[Rule, ...], bucket_rows: int) -> tuple[DataFrame, Callable[[Column], Column]]:
    """Of each document with any span: its keys and `spans` as SPANS in order. With it a test that each such text passes."""
    free = [k for k, x in enumerate(rules) if not trigram_query(x.pattern)]
    small, may = candidates(docs, rules, bucket_rows)
    rows = docs.select(*_keys(), F.coalesce("text", F.lit("")).alias("text"))
    met = rows.where(may(F.col("text"))).join(small, F.col("sec_key") == F.col("key"))
    each = [F.when(F.array_contains("asked", k), _tagged(F.col("text"), x, k)).otherwise(F.array().cast(SPANS)) for k, x in enumerate(rules) if k not in free]
    parts = []
    if each:
        parts.append(met.select("sec_key", "sec_text", F.explode(F.concat(*each)).alias("s")))
    if free:
        parts.append(rows.select("sec_key", "sec_text", F.explode(F.concat(*(_tagged(F.col("text"), rules[k], k) for k in free))).alias("s")))
    all_ = parts[0].union(parts[-1]) if len(parts) > 1 else parts[0]

    def any_(text: Column) -> Column:
        out = may(text)
        for k in free:
            out = out | text.rlike(rules[k].pattern)
        return F.coalesce(out, F.lit(False))

    # rows that are alike have the same spans; each counts once
    return all_.groupBy("sec_key", "sec_text").agg(F.array_sort(F.collect_set("s")).alias("spans")), any_


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id and `spans` (array<struct<start, rule, end>>, by start, then rule) of every row."""
    found, _ = _found(docs, rules, bucket_rows)
    key, text = _keys()
    own = docs.select("doc_id", key.alias("own_key"), text.alias("own_text"))
    met = own.join(found, (F.col("own_key") == F.col("sec_key")) & (F.col("own_text") == F.col("sec_text")), "left")
    return met.select("doc_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """The counts, the hash of the base spans and all spans of scan() as text."""
    kinds = F.array(*(F.lit(x.kind) for x in rules))

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    basic = F.filter("spans", lambda s: s["rule"] < base)
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{x.kind}") for k, x in enumerate(rules[:base])]
    return found.select("doc_id", *counts, F.sha2(said(basic), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def _is(k: int):
    return lambda s: s["rule"] == k


def _marked(text: Column, spans: Column, mark: str) -> Column:
    """The text with spans (in order) replaced; those that touch or overlap are one."""

    def cut(gaps: Column) -> Column:
        """What stands before each of a row of gaps' ends, from one piece of the text."""
        first, last = F.element_at(gaps, 1)["begin"], F.element_at(gaps, -1)["end"]
        piece = F.substring(text, (first + 1).cast("int"), (last - first).cast("int"))
        return _bound(piece, lambda p: F.transform(gaps, lambda g: F.substring(p, (g["begin"] - first + 1).cast("int"), (g["end"] - g["begin"]).cast("int"))))

    def said(upto: Column) -> Column:
        gaps = F.transform(spans, lambda s, i: F.struct(F.coalesce(F.get(upto, i - 1), F.lit(0)).alias("begin"), s["start"].alias("end"), (i == 0).alias("is_first")))
        kept = F.filter(gaps, lambda g: g["is_first"] | (g["end"] > g["begin"]))
        rest = F.substring(text, (F.element_at(upto, -1) + 1).cast("int"), F.length(text))
        return F.array_join(F.concat(F.flatten(_bound(kept, lambda k: _in_rows(k, cut))), F.array(rest)), mark)

    return _bound(running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.when(a.isNotNull(), F.greatest(a, b))), said)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, bucket_rows: int = BUCKET_ROWS, mark: str = "[secret]") -> DataFrame:
    """`docs` with every span (spans that touch or overlap: all together) replaced by `mark`; all rows and columns stay.

    Texts that can't have a span, by the test that comes with the spans, don't move.
    """
    found, may = _found(docs, rules, bucket_rows)
    key, text, spans, out = fresh(docs, "sec_key", "sec_text", "sec_spans", "sec_out")
    held = materialize(found, "spans").select(F.col("sec_key").alias(f"{key}_"), F.col("sec_text").alias(f"{text}_"), F.col("spans").alias(spans))
    has = may(F.col("text"))
    own = docs.where(has).withColumns(dict(zip((key, text), _keys(), strict=True)))
    met = own.join(held, (F.col(key) == F.col(f"{key}_")) & (F.col(text) == F.col(f"{text}_")), "left")
    done = met.withColumn(out, F.when(F.col(spans).isNull(), F.col("text")).otherwise(_marked(F.col("text"), F.col(spans), mark)))
    changed = {"text": F.col(out)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length(out)).cast(dict(docs.dtypes)["n_chars"])
    return done.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns)).union(docs.where(~has))


def oracle(rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> str:
    """The result of digest() in DuckDB SQL, which runs every rule on every text, without an index."""

    def either_case(pattern: str) -> str:
        """`(?i:...)` with both cases of its ASCII letters: DuckDB would let other letters that fold to them in too."""
        return re.sub(r"\(\?i:([^()]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", pattern)

    rows = ", ".join(f"({k}, '{x.kind}')" for k, x in enumerate(rules))
    found = " UNION ALL ".join(
        f"SELECT n, {k} AS rule, regexp_extract_all(text, '{p}', 0) AS hits, regexp_extract_all(text, '{p}', {x.group}) AS own, string_split_regex(text, '{p}') AS gaps, {x.least} AS least FROM d"
        for k, x in enumerate(rules)
        for p in [either_case(x.pattern).replace("'", "''")]
    )
    counts = ", ".join(f"coalesce(count(*) FILTER (rule = {k}), 0)::BIGINT AS n_{x.kind}" for k, x in enumerate(rules[:base]))
    said = "kind || ':' || start || ':' || (start + long), ',' ORDER BY start, rule"
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
  k(rule, kind) AS (VALUES {rows}),
  f AS ({found}),
  m AS (SELECT n, rule, least, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(own) AS own, unnest(gaps[1:len(hits)]) AS gap FROM f WHERE len(hits) > 0),
  p AS (SELECT n, rule, least, length(hit)::BIGINT AS long, length(own) AS own, (sum(length(gap) + length(hit)) OVER (PARTITION BY n, rule ORDER BY i) - length(hit))::BIGINT AS start FROM m),
  s AS (SELECT n, {counts}, string_agg({said}) FILTER (rule < {base}) AS base, string_agg({said}) AS spans FROM p JOIN k USING (rule) WHERE own >= least GROUP BY n)
SELECT doc_id, {", ".join(f"coalesce(n_{x.kind}, 0) AS n_{x.kind}" for x in rules[:base])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (n)
"""
