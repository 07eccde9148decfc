"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Sizes are counted in words. The corpus is `T` words; blocks of `B` words each (`T / blocks`, at least one
word) are allocated to sources by their targets' highest quotients target / (2j + 1). Blocks in the order
of their quotients fill one shard after the other, so each shard has an integer quota of every such source.

A source's documents lie on a line in seeded order (by the MD5 of seed, doc_id and text), which is cut into
blocks; a document belongs to the block in which it begins. The seed also orders the blocks (by the MD5 of seed,
source and block): in this order the shards draw their quotas, one after the other, through the line as often as
it takes. So a document is in the shard that draws its block at its place (`shards`: one for each time that it is
taken), and of a source only the last document taken is cut: targets are met to the word of their quotas.

Whole blocks are too coarse for a source whose target is below `FINE` of them (the width grows with the
corpus): it takes its target to the word, shared evenly by the shards, and leaves its share of the blocks to
nobody. So a source's taken words differ from its target by a word or about a `FINE`-th at any size of the corpus.

Scale: only (doc_id, source, size, hashes) leave the scan. Rows that are alike become one with a number before the
first shuffle. The line is laid out in cells, the first digits of the MD5, so that a source with any share of all
rows is sorted in many tasks; what is kept of a cell is its sum. The tables of sources, quotas (at most
`blocks / FINE` sources by `shards`), blocks (`blocks` plus one a source) and cells are small beside the documents.

Defined results: a null text has size 0 and takes nothing; null is a source of its own, the last; rows
that share a doc_id are each a document, ordered by their texts' hashes; an empty table gives no rows; other
columns are ignored by taken() and kept by mix() whatever their names. Where all sizes are 0, so are all targets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.llm.shared import fresh, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
BLOCKS = 1 << 16
SHARDS = 64
#: Blocks of a target, from which on whole blocks are near enough.
FINE = 64
#: Copies of one row that a task tells out at once.
COPIES = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Of each source (source, source_size): rank by code point, and target.

    Weights share the total size; a target stops at `most` times its source's size and what is left is shared
    by weight again. That is the level at which, by rising cap per weight, caps are no longer reached.
    """
    by_name, all_ = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    capped = weighed.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("total", F.sum("source_size").over(all_).cast("double"))
    rising = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    shares = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    full = capped.withColumn("full", left / shares >= F.col("cap") / F.col("weight"))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_), F.lit(0.0))
    open_ = F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * rest / open_))
    return full.select("source", "source_size", "rank", "total", target.alias("target"))


def measured_in_blocks(aims: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """`aims` with `width`, the words of a block, and whether a source is too small for whole blocks; single words are never too coarse."""
    sized = aims.where("total > 0").withColumn("width", F.greatest(F.lit(1), F.floor(F.col("total") / blocks)).cast("long"))
    return sized.withColumn("small", (F.col("width") > 1) & (F.col("target") < FINE * F.col("width")))


def quotas(aims: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """Blocks of each source in each shard: rank, shard, blocks; with `width`, the words of a block.

    All `n` blocks go to the `n` highest quotients; equal ones to the lower rank. Small sources have none.
    """
    all_ = W.partitionBy(F.lit(0))
    sized = measured_in_blocks(aims, blocks).withColumn("apart", F.coalesce(F.sum(F.when(F.col("small"), F.col("target"))).over(all_), F.lit(0.0)))
    counted = sized.where("not small").withColumn("n", F.round((F.col("total") - F.col("apart")) / F.col("width")).cast("long")).withColumn("sources", F.count("*").over(all_))
    # an allocation at another divisor than the width is off by less than a source's share of all roundings
    most = F.ceil(F.col("target") / F.col("width") * (1 + F.col("sources") / F.col("n"))) + 2
    seats = counted.where("target > 0").select("rank", "width", "n", "target", F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long"))).alias("j"))
    ordered = seats.withColumn("place", F.row_number().over(W.orderBy((F.col("target") / (2 * F.col("j") + 1)).desc(), "rank", "j")))
    won = ordered.where("place <= n").withColumn("shard", F.floor((F.col("place") - 1) * shards / F.col("n")).cast("int"))
    return won.groupBy("rank", "shard", "width").agg(F.count("*").alias("blocks"))


def plan(aims: DataFrame, quota: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, most: int = MOST) -> DataFrame:
    """Of each source with words: rank, width, source_size, words (to take), small, and `ends`: the words of its quotas up to the end of each shard (null for small ones)."""
    each = quota.select("rank").distinct().withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    upto = W.partitionBy("rank").orderBy("shard")
    given = each.join(quota, ["rank", "shard"], "left").withColumn("upto", F.sum(F.coalesce("blocks", F.lit(0))).over(upto))
    ends = given.groupBy("rank").agg(F.array_sort(F.collect_list("upto")).alias("upto"))
    sized = measured_in_blocks(aims, blocks).where("source_size > 0").join(ends, "rank", "left")
    asked = F.when(F.col("small"), F.round("target").cast("long")).otherwise(F.coalesce(F.element_at("upto", -1) * F.col("width"), F.lit(0)))
    return sized.select("rank", "width", "source_size", F.least(asked, most * F.col("source_size")).alias("words"), "small", F.transform("upto", lambda x: x * F.col("width")).alias("ends"))


def shard_of(at: Column, shards: int) -> Column:
    """The shard that draws the word at place `at` of all that a source gives."""
    even = F.floor(at * shards / F.col("words"))
    return F.when(F.col("small"), even).otherwise(F.size(F.filter("ends", lambda x: x <= at))).cast("int")


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    return materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text", "source").alias("mix_row")), "sizes")


def _lined(measured: DataFrame, aims: DataFrame) -> DataFrame:
    """Every row with its source's rank and `begin`, its place on the source's line."""
    rows = measured.count()
    digits = max(2, math.ceil(math.log(max(rows, 1) / 4096, 16))) if rows > 4096 else 2
    alike = measured.groupBy("source", "key", "doc_id", "size", "mix_row").agg(F.count("*").alias("n"))
    ranked = alike.join(aims.select(F.col("source").alias("mix_source"), "rank"), F.col("source").eqNullSafe(F.col("mix_source"))).drop("source", "mix_source").withColumn("cell", F.substring("key", 1, digits))
    placed = ranked.withColumn("all", F.col("size") * F.col("n"))
    line = W.partitionBy("rank").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = placed.groupBy("rank", "cell").agg(F.sum("all").alias("cell_size")).select(F.col("rank").alias("c_rank"), F.col("cell").alias("c_cell"), F.coalesce(F.sum("cell_size").over(line), F.lit(0)).alias("c_begin"))
    inside = W.partitionBy("rank", "cell").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    begun = placed.withColumn("in_cell", F.coalesce(F.sum("all").over(inside), F.lit(0))).join(cells, (F.col("rank") == F.col("c_rank")) & (F.col("cell") == F.col("c_cell"))).withColumn("begin", F.col("in_cell") + F.col("c_begin"))
    # copies of one row are told out in parts, so that no task has all of them
    parts = begun.select("doc_id", "rank", "size", "mix_row", "begin", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("part")).repartition("mix_row", "part")
    each = F.sequence(F.col("part") * COPIES, F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1)
    return parts.select("doc_id", "rank", "size", "mix_row", "begin", F.explode(each).alias("copy")).select("doc_id", "rank", "size", "mix_row", (F.col("begin") + F.col("copy") * F.col("size")).alias("begin"))


def _taken(measured: DataFrame, seed: int, blocks: int, shards: int, weights: tuple[int, ...], most: int) -> DataFrame:
    aims = materialize(targets(measured.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    plans = materialize(plan(aims, quotas(aims, blocks, shards), blocks, shards, most), "plans")
    wide = plans.agg(F.max("width")).first()[0] or 1  # the same for all sources
    line = materialize(_lined(measured, aims).withColumn("block", F.when(F.col("size") > 0, F.floor(F.col("begin") / wide))), "line")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rank").cast("string"), F.col("block").cast("string")))
    drawn = W.partitionBy("rank").orderBy(key, "block").rowsBetween(W.unboundedPreceding, -1)
    laid = line.where("block is not null").groupBy("rank", "block").agg(F.sum("size").alias("long"), F.min("begin").alias("first"))
    block = laid.select(F.col("rank").alias("b_rank"), F.col("block").alias("b_block"), (F.coalesce(F.sum("long").over(drawn), F.lit(0)) - F.col("first")).alias("shift"))
    met = line.join(block, (F.col("rank") == F.col("b_rank")) & (F.col("block") == F.col("b_block")), "left").withColumn("at", F.col("begin") + F.col("shift"))
    own = met.join(aims.select("rank", "target", F.col("source_size").alias("all_size")), "rank").join(plans.drop("width"), "rank", "left")
    passes = F.floor(F.col("words") / F.col("source_size"))
    rest = F.col("words") - passes * F.col("source_size")
    took = own.withColumn("whole", passes).withColumn("part", F.greatest(F.lit(0), F.least("size", rest - F.col("at"))))
    times = F.when(F.col("at").isNull(), 0).otherwise(F.coalesce(F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0), F.lit(0)))
    turns = F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<bigint>"))
    drawn_by = F.array_join(F.transform(turns, lambda k: shard_of(k * F.col("source_size") + F.col("at"), shards).cast("string")), ",")
    taken = F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.coalesce(F.col("whole") * F.col("size") + F.col("part"), F.lit(0)))
    return took.select("doc_id", "mix_row", "size", F.col("all_size").alias("source_size"), "target", taken.cast("long").alias("taken"), drawn_by.alias("shards"))


def taken(docs: DataFrame, seed: int = SEED, blocks: int = BLOCKS, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes of it, repeats counted) and shards (of each time it is taken, comma-joined) of every row."""
    return _taken(_measured(docs, seed), seed, blocks, shards, weights, most).drop("mix_row")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word's trailing blanks, unchanged otherwise."""
    parts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.array_join(F.slice(parts, 1, (n + lead).cast("int")), "")


def mix(docs: DataFrame, seed: int = SEED, blocks: int = BLOCKS, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed corpus with the columns of `docs`: a row for each whole time that a document is taken, and for
    the words beyond, one with its first so many words. Rows that are alike share what they take, whole words each."""
    alike = _taken(_measured(docs, seed), seed, blocks, shards, weights, most).groupBy("doc_id", "mix_row").agg(F.floor(F.sum("taken") / F.count("*")).alias("taken"), F.max("size").alias("size"))
    row, asked, size, of, time, out = fresh(docs, "mix_row", "mix_taken", "mix_size", "mix_id", "mix_time", "mix_text")
    some = alike.where("taken > 0").select(F.col("doc_id").alias(of), F.col("mix_row").alias(f"{row}_"), F.col("size").alias(size), F.col("taken").alias(asked))
    own = docs.withColumn(row, F.xxhash64("text", "source"))
    met = own.join(some, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(row) == F.col(f"{row}_")))
    full, part = F.floor(F.col(asked) / F.col(size)), F.col(asked) % F.col(size)
    times = met.withColumn(time, F.explode(F.sequence(F.lit(1).cast("long"), full + F.when(part > 0, 1).otherwise(0))))
    done = times.withColumn(out, F.when(F.col(time) > full, first_words(F.col("text"), part)).otherwise(F.col("text")))
    changed = {"text": F.col(out), "n_chars": F.length(out).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return done.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def oracle(seed: int = SEED, blocks: int = BLOCKS, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> str:
    """The result of taken() in DuckDB SQL."""
    cases = " ".join(f"WHEN {k} THEN {float(w)}" for k, w in enumerate(weights))
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
      md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
  r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, sum(source_size) OVER ()::DOUBLE AS total, {most} * source_size::DOUBLE AS cap FROM s),
  w AS (SELECT *, (CASE (rank - 1) % {len(weights)} {cases} END)::DOUBLE AS weight FROM r),
  l AS (SELECT *, total - coalesce(sum(cap) OVER b, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS shares FROM w
    WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f AS (SELECT *, lft / shares >= cap / weight AS reached FROM l),
  t AS (SELECT source, source_size, rank, total, CASE WHEN reached THEN cap ELSE least(cap, weight * (total - coalesce(sum(cap) FILTER (reached) OVER (), 0)) / sum(weight) FILTER (NOT reached) OVER ()) END AS target FROM f),
  z AS (SELECT *, greatest(1, floor(total / {blocks}))::BIGINT AS width FROM t WHERE total > 0),
  y AS (SELECT *, width > 1 AND target < {FINE} * width AS small FROM z),
  x AS (SELECT *, coalesce(sum(target) FILTER (small) OVER (), 0) AS apart FROM y),
  n AS (SELECT *, round((total - apart) / width)::BIGINT AS n, count(*) OVER () AS sources FROM x WHERE NOT small),
  q AS (SELECT rank, n, target, unnest(range(0, (ceil(target / width * (1 + sources / n)) + 3)::BIGINT)) AS j FROM n WHERE target > 0),
  o AS (SELECT rank, n, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, rank, j) AS place FROM q),
  g AS (SELECT rank, ((place - 1) * {shards}) // n AS shard, count(*) AS blocks FROM o WHERE place <= n GROUP BY ALL),
  e AS (SELECT rank, list((SELECT coalesce(sum(blocks), 0) FROM g AS h WHERE h.rank = a.rank AND h.shard <= a.shard)::BIGINT ORDER BY shard) AS upto
    FROM (SELECT DISTINCT rank, unnest(range(0, {shards})) AS shard FROM g) a GROUP BY rank),
  p AS (SELECT y.rank, width, source_size, small, upto, least(CASE WHEN small THEN round(target)::BIGINT ELSE coalesce(upto[-1] * width, 0) END, {most} * source_size)::BIGINT AS words
    FROM y LEFT JOIN e ON y.rank = e.rank WHERE source_size > 0),
  a AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rank, p.* EXCLUDE (rank, source_size),
      (coalesce(sum(size) OVER (PARTITION BY t.rank ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN p ON p.rank = t.rank),
  b AS (SELECT *, CASE WHEN size > 0 THEN start // width END AS block FROM a),
  c AS (SELECT rank, block, coalesce(sum(sum(size)) OVER (PARTITION BY rank ORDER BY md5('{seed}:' || rank || ':' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - min(start) AS shift
    FROM b WHERE block IS NOT NULL GROUP BY rank, block),
  v AS (SELECT b.*, (start + shift)::BIGINT AS pos, words // source_size AS passes, greatest(0, least(size, words % source_size - (start + shift))) AS part FROM b LEFT JOIN c ON b.rank = c.rank AND b.block = c.block)
SELECT doc_id, size, source_size, target, (CASE WHEN pos IS NULL THEN 0 ELSE passes * size + part END)::BIGINT AS taken,
  CASE WHEN pos IS NULL THEN '' ELSE array_to_string(list_transform(range(0, (passes + (part > 0)::INT)::BIGINT),
    lambda k: CASE WHEN small THEN floor((k * source_size + pos) * {shards} / words)::BIGINT ELSE len(list_filter(upto, lambda u: u * width <= k * source_size + pos)) END), ',') END AS shards FROM v
"""
