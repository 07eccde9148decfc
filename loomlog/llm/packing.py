"""Hierarchical multi-length packing of documents into training sequences.

Each task packs the documents of its own input split, so no row is shuffled:

* whole windows of the longest tier are cut from long documents; they have no gap;
* what is left of a document is routed to the shortest tier (context size) that holds it;
* tiers are packed from the longest down: a piece opens a window of its tier, the gap is filled with the
  longest whole pieces that fit, from the same and from shorter tiers, and only when none fits, the
  shortest piece is cut to close it. So every window but a task's last is full;
* the last window of a task is cut into sequences of exact powers of two, which need no padding;
* a task's sequences of all tiers are dealt to step groups of equal tokens and about equal attention cost (sum
  of squared piece lengths), so that steps take about equally long.

Memory: one Arrow batch, one portion's ids, at most one unfilled window carried on, and the numbers of the
pieces in `HELD_STEPS` steps.

Defined results: a null text is an empty one (its only id is the end id); an empty table gives no rows; a
row that is repeated is packed each time; a null doc_id is kept; other columns are ignored, whatever
their names; a text of any length is packed whole.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomlog.llm.shared import portions
from loomlog.llm.tokens import ENCODE_BYTES, VOCABULARY, encode

TIERS = (2048, 1024, 512, 256)
END_ID = 1
STEP_TOKENS = 1 << 16
#: Steps' worth of sequences that a task holds before it deals half of them.
HELD_STEPS = 128
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context long, step_group long"


class Pool:
    """Pieces (document, start, length) by length, with the lengths at hand as bits of a number."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.bits = 0

    def put(self, doc: int, start: int, length: int) -> None:
        self.by.setdefault(length, []).append((doc, start))
        self.bits |= 1 << length

    def take(self, length: int) -> tuple[int, int, int]:
        own = self.by[length]
        doc, start = own.pop()
        if not own:
            del self.by[length]
            self.bits ^= 1 << length
        return doc, start, length

    def longest(self, most: int) -> int:
        """The greatest length up to `most`, or 0."""
        return max(0, (self.bits & ((2 << most) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.bits & -self.bits).bit_length() - 1


def window(pool: Pool, context: int) -> tuple[list[tuple[int, int, int]], int]:
    """Fills one window of `context` ids, first with the longest piece that fits; returns its pieces and the gap."""
    pieces, gap = [], context
    while gap and pool.bits:
        if fits := pool.longest(gap):
            pieces.append(pool.take(fits))
            gap -= fits
        else:
            doc, start, length = pool.take(pool.shortest())
            pieces.append((doc, start, gap))
            pool.put(doc, start + gap, length - gap)
            gap = 0
    return pieces, gap


def pack(pool: Pool, tiers: tuple[int, ...]) -> tuple[list[tuple[int, list]], list]:
    """Full windows as (context, pieces), and the pieces of the one that the pool could not fill."""
    full = []
    for tier, below in zip(tiers, [*tiers[1:], 0], strict=True):
        while pool.longest(tier) > below:
            pieces, gap = window(pool, tier)
            if gap:
                return full, pieces
            full.append((tier, pieces))
    return full, []


def closed(pieces: list) -> list[tuple[int, list]]:
    """Sequences of exact powers of two, longest first, from the pieces of an unfilled window."""
    out, left = [], list(reversed(pieces))
    total = sum(x[2] for x in pieces)
    for size in (1 << k for k in reversed(range(total.bit_length()))):
        if not total & size:
            continue
        own, gap = [], size
        while gap:
            doc, start, length = left.pop()
            own.append((doc, start, min(gap, length)))
            if length > gap:
                left.append((doc, start + gap, length - gap))
            gap -= own[-1][2]
        out.append((size, own))
    return out


class Steps:
    """Deals a task's sequences to step groups of about `step_tokens`, over all context sizes at once.

    Longer sequences go first, costlier ones (sum of squared piece lengths) before cheaper ones of their size,
    each to the group with the fewest tokens so far and among those the least cost. As sizes are powers of two
    times the shortest, groups of one deal differ by no more than one longest sequence. What is held is dealt
    once it makes `HELD_STEPS` steps, half of it, so the last deal has half of them at least (or is the only one).
    """

    def __init__(self, step_tokens: int) -> None:
        self.step_tokens, self.held, self.tokens, self.groups = step_tokens, [], 0, 0

    def add(self, context: int, pieces: list[tuple[int, int, int]], rows: list[tuple]) -> None:
        self.held.append((context, sum(x[2] ** 2 for x in pieces), rows))
        self.tokens += context

    def dealt(self, all_: bool) -> list[tuple]:
        """Rows with their groups: of half of what is held if that is much, or of everything."""
        if not all_ and self.tokens < HELD_STEPS * self.step_tokens:
            return []
        own, rest, tokens = [], [], 0
        for x in self.held:
            (own if all_ or 2 * tokens < HELD_STEPS * self.step_tokens else rest).append(x)
            tokens += x[0]
        self.held, self.tokens = rest, sum(x[0] for x in rest)
        groups = step_groups([x[:2] for x in own], self.step_tokens)
        out = [(*row, self.groups + g) for (*_, rows), g in zip(own, groups, strict=True) for row in rows]
        self.groups += max(groups, default=-1) + 1
        return out


def step_groups(sequences: list[tuple[int, int]], step_tokens: int) -> list[int]:
    """The number of the step group of each sequence (context, cost)."""
    n = max(1, round(sum(x[0] for x in sequences) / step_tokens))
    groups = [0] * len(sequences)
    heap = [(0, 0, g) for g in range(n)]
    for k in sorted(range(len(sequences)), key=lambda k: (-sequences[k][0], -sequences[k][1], k)):
        tokens, cost, g = heap[0]
        groups[k] = g
        heapq.heapreplace(heap, (tokens + sequences[k][0], cost + sequences[k][1], g))
    return groups


def _pack_task(batches: Iterator[pa.RecordBatch], tiers: tuple[int, ...], path: str, end_id: int, step_tokens: int) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 36
    next_sequence = 0
    kept: dict[int, tuple] = {}  # documents with pieces in the unfilled window
    carried: list[tuple[int, int, int]] = []
    steps = Steps(step_tokens)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def hold(sequences: list[tuple[int, list]], docs: dict[int, tuple]) -> None:
        nonlocal next_sequence
        for context, pieces in sequences:
            offset, own = 0, []
            for doc, start, length in pieces:
                doc_id, ids, skipped, tokens = docs[doc]
                crc = zlib.crc32(ids[start - skipped : start - skipped + length])
                own.append((doc_id, start, length, crc, tokens, base + next_sequence, offset, context))
                offset += length
            steps.add(context, pieces, own)
            next_sequence += 1

    def rows(all_: bool = False) -> Iterator[pa.RecordBatch]:
        if out := steps.dealt(all_):
            columns = list(zip(*out, strict=True))
            columns[-1] = [base + g for g in columns[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

    number = 0
    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for lo, hi in portions(texts, ENCODE_BYTES):
            ids, at = encode(texts[lo:hi], path, end_id)
            docs, pool, sequences = dict(kept), Pool(), []
            for piece in carried:
                pool.put(*piece)
            for k in range(hi - lo):
                own = ids[at[k] : at[k + 1]].astype("<u4", copy=False)
                number += 1
                docs[number] = (doc_ids[lo + k], own, 0, len(own))
                whole = len(own) // tiers[0] * tiers[0]
                sequences += [(tiers[0], [(number, start, tiers[0])]) for start in range(0, whole, tiers[0])]
                if len(own) > whole:
                    pool.put(number, whole, len(own) - whole)
            full, carried = pack(pool, tiers)
            kept = {}
            for doc in {x[0] for x in carried}:  # only the ids that are still to come
                doc_id, own, skipped, tokens = docs[doc]
                first = min(x[1] for x in carried if x[0] == doc)
                kept[doc] = (doc_id, own[first - skipped :].copy(), first, tokens)
            hold(sequences + full, docs)
            del docs, ids
            yield from rows()
    if carried:
        hold(closed(carried), kept)
    yield from rows(all_=True)


def pack_documents(docs: DataFrame, tiers: tuple[int, ...] = TIERS, path: str = VOCABULARY, end_id: int = END_ID, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """A row per piece: where it lies in its document and in its sequence, `context` (padded size of that
    sequence) and `step_group`. Every id of every document lies in exactly one piece."""
    tiers = tuple(sorted(tiers, reverse=True))
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _pack_task(batches, tiers, path, end_id, step_tokens), SCHEMA)
