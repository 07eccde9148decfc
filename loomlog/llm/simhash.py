"""SimHash near-duplicates: fingerprints, an exact tiled comparison of all of them, and their components.

1. A task hashes the shingles of its own rows (XXH64 of the bytes, many at once in numpy) and sums the
   bits of each document. Only (doc_id, fingerprint) leaves it.
2. Equal fingerprints become one row, so copies, however many, are compared once.
3. Fingerprints are dealt to tiles by their number of set bits (and by hash where one number has more than
   a tile's rows). Two fingerprints at most r bits apart have counts at most r apart, so only such tiles
   meet: each fingerprint is sent to the pairs of tiles that its own tile is part of.
4. A task that has a pair of tiles orders each by the bit counts of its four 16-bit quarters and compares
   the runs of equal counts, with exclusive-or and bit counts in numpy; pairs of runs whose counts differ
   by more than r in sum are skipped. Nothing is sampled or hashed: the comparison is exact. It returns a
   spanning forest of the links that it found, never all pairs.
5. Components: rounds of large-star and small-star on the forest's links until they no longer change, each
   written to the shared folder, so a lost executor costs one round at most.

Cost: the comparison is quadratic in distinct fingerprints, divided by about eight by the quarters'
counts; a pair costs about a nanosecond.

Defined results: null, empty and wordless texts have fingerprint zero and are linked like any other;
repeated rows, and rows that share a doc_id, are a document each; rows with a null doc_id keep their
fingerprint and take the component of the others (null if none of them has a doc_id); an empty table gives no rows;
other columns are ignored (and kept by keep_one() whatever their names); texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.shared import fresh, materialize, portions, raw, words

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Rows of a tile at most. A number of set bits with fewer fingerprints is one tile, so that each is sent to
#: nine pairs; beyond, to nine for each such tile of a number.
TILE_ROWS = 1 << 18
BLOCK = 2048

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))  # fixed values of XXH64


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _mix(sum_: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(sum_ + lane * P2, 31) * P1


def xxh64(data: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[begin[i] : begin[i] + size[i]] for every i, those of equal size together."""
    out = np.empty(len(begin), np.uint64)
    if not len(begin):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    four = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        own = order[lo:hi]
        n, at = int(size[own[0]]), begin[own]
        if hi - lo < 8 or n > 512:
            for k in own:
                out[k] = xxhash.xxh64_intdigest(data[begin[k] : begin[k] + n].tobytes(), seed)
            continue
        done = 0
        if n >= 32:
            first = np.uint64(seed)
            with np.errstate(over="ignore"):
                v = [np.full(len(at), x, np.uint64) for x in (first + P1 + P2, first + P2, first, first - P1)]
            while done + 32 <= n:
                v = [_mix(x, eight[at + (done + 8 * k)]) for k, x in enumerate(v)]
                done += 32
            h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for x in v:
                h = (h ^ _mix(np.zeros_like(x), x)) * P1 + P4
        else:
            with np.errstate(over="ignore"):
                h = np.full(len(at), np.uint64(seed) + P5, np.uint64)
        h = h + np.uint64(n)
        while done + 8 <= n:
            h = _turn(h ^ _mix(np.zeros_like(h), eight[at + done]), 27) * P1 + P4
            done += 8
        if done + 4 <= n:
            h = _turn(h ^ (four[at + done].astype(np.uint64) * P1), 23) * P2 + P3
            done += 4
        while done < n:
            h = _turn(h ^ (data[at + done].astype(np.uint64) * P5), 11) * P1
            done += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        out[own] = h ^ (h >> np.uint64(32))
    return out


def shingled(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by single spaces; begin and size of each shingle of `n` words in them; how many each text has.

    A text of fewer words has one shingle, all of its words; one without words has none.
    """
    starts, ends, first = words(data, at)
    long = ends - starts
    place = np.cumsum(long + 1) - (long + 1)
    joined = np.full(int((long + 1).sum()), 0x20, np.uint8)
    low = data + (((data >= 0x41) & (data <= 0x5A)) * np.uint8(0x20))
    shift = np.repeat(place - starts, long)
    where = np.repeat(starts, long) + (np.arange(len(shift)) - np.repeat(np.cumsum(long) - long, long))
    joined[where + shift] = low[where]
    per = np.diff(first)
    count = np.where(per > 0, np.maximum(per - n + 1, 1), 0)
    head = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    tail = np.minimum(head + n, np.repeat(first[1:], count)) - 1
    return joined, place[head], place[tail] + long[tail] - place[head], count


def fingerprints(texts: pa.Array, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    data, at = raw(texts)
    joined, begin, size, count = shingled(data, at, n)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    bits = np.unpackbits(xxh64(joined, begin, size, seed).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, (np.cumsum(count) - count)[full], axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * ones > count[full][:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _fingerprint_task(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2)
        own = [fingerprints(texts[lo:hi], n) for lo, hi in portions(texts)]
        values = np.concatenate(own) if own else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], names=["sh_id", "sh_text", "sh_print"])


def _runs(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by the quarters' bit counts, where each run of equal counts begins, and the counts of the runs."""
    counts = np.bitwise_count(prints.view("<u2").reshape(-1, 4)).astype(np.int32)
    key = counts @ np.array([17**3, 17**2, 17, 1], np.int32)
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.diff(key[order], prepend=-1))
    return order, np.append(begin, len(order)), counts[order[begin]]


def _roots(up: list[int], rows: np.ndarray) -> np.ndarray:
    out = rows.tolist()
    for i, k in enumerate(out):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        out[i] = k
    return np.array(out, np.int64)


def link(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of all links between `left` and `right` (or within `left`), as numbers of rows, those of `right` after `left`'s."""
    same = right is None
    right, shift = (left, 0) if same else (right, len(left))
    up = list(range(shift + len(right)))
    edges: list[tuple[int, int]] = []
    (lo, lb, lc), (ro, rb, rc) = _runs(left), _runs(right)
    ls, rs = left[lo], right[ro]
    reach = np.abs(lc[:, None, :] - rc[None, :, :]).sum(axis=2, dtype=np.int32) <= radius if len(lc) * len(rc) < 4_000_000 else None
    for i in range(len(lc)):
        near = np.flatnonzero(reach[i] if reach is not None else np.abs(lc[i] - rc).sum(axis=1) <= radius)
        if same:
            near = near[near >= i]
        if not len(near):
            continue
        columns = np.concatenate([np.arange(rb[k], rb[k + 1]) for k in near])
        for a in range(lb[i], lb[i + 1], BLOCK):
            x = ls[a : min(a + BLOCK, lb[i + 1])]
            for b in range(0, len(columns), 16 * BLOCK):
                own = columns[b : b + 16 * BLOCK]
                step = max(1, (1 << 21) // len(own))
                for c in range(0, len(x), step):
                    hit = np.bitwise_count(x[c : c + step, None] ^ rs[own][None, :]) <= radius
                    if hit.any():
                        _join(hit, lo[a + c : a + c + step], ro[own] + shift, up, edges)
    return edges


def _join(hit: np.ndarray, rows: np.ndarray, columns: np.ndarray, up: list[int], edges: list[tuple[int, int]]) -> None:
    """Adds the links in `hit` between groups that aren't one yet: the first of each row and column, until none is left."""
    while True:
        some, other = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        hit, rows, columns = hit[np.ix_(some, other)], rows[some], columns[other]
        hit &= _roots(up, rows)[:, None] != _roots(up, columns)[None, :]
        by_row, by_column = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        if not len(by_row):
            return
        r = np.concatenate([by_row, hit[:, by_column].argmax(axis=0)])
        c = np.concatenate([hit[by_row].argmax(axis=1), by_column])
        for x, y in zip(rows[r].tolist(), columns[c].tolist(), strict=True):
            a, b = _roots(up, np.array([x, y])).tolist()
            if a != b:
                up[max(a, b)] = min(a, b)
                edges.append((x, y))


def _compare(group: pd.DataFrame, radius: int) -> pd.DataFrame:
    prints, right = group["sh_print"].to_numpy(), group["sh_right"].to_numpy()
    left, other = prints[~right], prints[right]
    edges = link(left.view(np.uint64), other.view(np.uint64) if right.any() else None, radius)
    ends = np.concatenate([left, other])[np.array(edges, np.int64).reshape(-1, 2)]
    return pd.DataFrame({"u": ends.max(axis=1), "v": ends.min(axis=1)})


def _bits(x: Column) -> Column:
    return F.bit_count(x).cast("int")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v), u > v, that connect all fingerprints `sh_print` within `radius` bits of each other."""
    counts = {r["bits"]: r["n"] for r in distinct.groupBy(_bits(F.col("sh_print")).alias("bits")).agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    tiles = [-(-counts.get(k, 0) // TILE_ROWS) for k in range(65 + radius)]
    slots, bits, slot = F.array(*map(F.lit, tiles)), F.col("bits"), F.col("slot")
    tiled = distinct.select("sh_print", _bits(F.col("sh_print")).alias("bits")).withColumn("slot", F.pmod(F.xxhash64("sh_print"), F.get(slots, bits)).cast("int"))

    def number(bits: Column, slot: Column) -> Column:
        return (bits * (1 << 24) + slot).cast("long")

    def pairs(there: Column, first: Column, last: Column, right: bool) -> Column:
        """The pairs of this row's tile with the tiles (there, first) to (there, last)."""
        def one(t: Column) -> Column:
            own, other = number(bits, slot), number(there, t)
            return F.struct((other if right else own).alias("a"), (own if right else other).alias("b"), F.lit(right).alias("right"))

        none = F.array().cast("array<struct<a:bigint,b:bigint,right:boolean>>")
        return F.when(last >= first, F.transform(F.sequence(first, last), one)).otherwise(none)

    # a tile is (bits, slot); it meets itself, the other slots of its own count, and all slots of the next counts
    sent = [pairs(bits, slot, slot, False), pairs(bits, slot + 1, F.get(slots, bits) - 1, False), pairs(bits, F.lit(0), slot - 1, True)]
    for d in range(1, radius + 1):
        sent += [pairs(bits + d, F.lit(0), F.get(slots, bits + d) - 1, False), pairs(bits - d, F.lit(0), F.get(slots, bits - d) - 1, True)]
    dealt = tiled.select("sh_print", F.explode(F.concat(*sent)).alias("p")).select("sh_print", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("p.right").alias("sh_right"))
    return dealt.groupBy("a", "b").applyInPandas(lambda group: _compare(group, radius), "u long, v long")


def components(edges: DataFrame, name: str = "component") -> DataFrame:
    """(node, component) of all nodes with links (u, v): the smallest node that can be reached.

    Large-star and small-star in turn (Kiveris et al. 2014). A node with very many links is a key only of
    a minimum, which is pre-aggregated, and of a join, whose large partitions AQE splits.
    """

    def star(pairs: DataFrame, both: bool) -> DataFrame:
        around = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else pairs
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = around.where("v > u" if both else "true").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not both:
            moved = moved.union(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def sign(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = materialize(edges.select("u", "v").distinct(), name)
    before, after = None, sign(now)
    while before != after:
        now = materialize(star(star(now, True), False), name)
        before, after = after, sign(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def classes(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Of every row: sh_id, sh_text (hash of its text), sh_print, sh_group (a number of its component) and sh_least (its smallest doc_id)."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("sh_text"), "text")
    prints = materialize(texts.mapInArrow(lambda batches: _fingerprint_task(batches, shingle), "sh_id long, sh_text long, sh_print long"), "prints")
    distinct = materialize(prints.groupBy("sh_print").agg(F.min("sh_id").alias("sh_least")), "distinct")
    found = components(links(distinct, radius), "links")
    grouped = distinct.join(found, distinct["sh_print"] == found["node"], "left").select("sh_print", F.coalesce("component", "sh_print").alias("sh_group"), "sh_least")
    least = grouped.groupBy("sh_group").agg(F.min("sh_least").alias("sh_least"))
    return prints.join(grouped.drop("sh_least").join(least, "sh_group"), "sh_print")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of `docs`."""
    return classes(docs, radius, shingle).select(F.col("sh_id").alias("doc_id"), F.lower(F.lpad(F.hex("sh_print"), 16, "0")).alias("fingerprint"), F.col("sh_least").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of `docs` for each component, with all its columns: that of the smallest doc_id (none at all comes last).

    Rows that share it are told apart by a hash of their texts; of rows that share both, any one stays.
    """
    first = classes(docs, radius, shingle).groupBy("sh_group").agg(F.min(F.struct(F.col("sh_id").isNull().alias("none"), "sh_id", "sh_text")).alias("h"))
    # plain, never null keys, so that both steps share one shuffle of the texts; rows that are alike go before it
    key = fresh(docs, "sh_none", "sh_id", "sh_text")
    heads = first.select(F.col("h.none").alias(key[0]), F.coalesce("h.sh_id", F.lit(0)).alias(key[1]), F.col("h.sh_text").alias(key[2]))
    own = docs.withColumn(key[0], F.col("doc_id").isNull()).withColumn(key[1], F.coalesce("doc_id", F.lit(0))).withColumn(key[2], F.xxhash64("text"))
    return own.dropDuplicates(key).join(heads, key, "left_semi").drop(*key)
