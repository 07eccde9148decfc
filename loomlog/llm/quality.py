"""Quality rules: counts of every text, and a decision list that is learned from labels.

A task counts the words, lines and repeats of its own rows in numpy (words and lines are compared as they
are, not by hashes); nothing is shuffled. The decision list is learned by sequential covering: a rule
(conjunction of thresholds) is grown on two thirds of the labelled rows by FOIL's gain, pruned on the rest,
and kept while it is precise there; the rows that it covers go, and the next one is grown. The list becomes
one Spark expression: when(rule 1) .when(rule 2) ... otherwise keep.

The list is fitted on `SAMPLE` labelled doc_ids at most, the first by a hash of doc_id, and on the first 2 * `SAMPLE`
of their rows by doc_id and ratios (ids may repeat); everything else covers all rows. With no labels, or none of one kind, the list is empty and only the base rules reject.

Defined results: a null text has no words, so it fails the base rules; repeated rows each get their
counts; rows with a null doc_id can't be labelled but are judged; an empty table gives no rows; other
columns are kept by keep_good() whatever their names (but for those that begin with `__q_`) and ignored otherwise;
texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.shared import portions, raw, words

SAMPLE = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_digits", "n_distinct")
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_MARKS = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_DIGITS = (np.arange(256) >= 48) & (np.arange(256) <= 57)

#: What rules may ask for, from the counts.
RATIOS = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "upper_case": ("n_upper", "n_letters"),
    "marks_a_word": ("n_marks", "n_words"),
    "digits_a_word": ("n_digits", "n_words"),
    "distinct_words": ("n_distinct", "n_words"),
}
Condition = tuple[str, str, float]


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal stretches."""
    size = np.where(starts < ends, ends - starts, 0)
    from_ = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    bounds = np.concatenate([[0], np.cumsum(size)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[from_]))).dictionary_encode().indices.to_numpy().astype(np.int64)


def _twice(texts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: does its (text, code) occur more than once; is it the first in order of rows."""
    order = np.lexsort((codes, texts))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(texts[order]) != 0) | (np.diff(codes[order]) != 0)
    group = np.cumsum(new) - 1
    many, first = np.empty(len(order), bool), np.empty(len(order), bool)
    many[order] = np.bincount(group)[group] > 1 if len(group) else False
    first[order] = new
    return many, first


def _per(texts: np.ndarray, flags: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(texts[flags], minlength=n).astype(np.int64)


def _within(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


def count(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    data, at = raw(texts)
    n = len(texts)
    starts, ends, first = words(data, at)
    n_words = np.diff(first)
    text_of = np.repeat(np.arange(n), n_words)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.bincount(text_of, weights=heads[ends] - heads[starts], minlength=n).astype(np.int64)
    code = _codes(data, starts, ends)
    _, new = _twice(text_of, code)
    # windows of three words; codes are below 2^21, as a portion is below 2^21 words or one text
    repeated = np.zeros(len(code), bool)
    if len(code) > 2:
        inside = text_of[:-2] == text_of[2:]
        pairs = np.unique(code[:-1] * (int(code.max()) + 1) + code[1:], return_inverse=True)[1]
        triples = pairs[:-1] * (int(code.max()) + 1) + code[2:]
        at_ = np.flatnonzero(inside)
        many, _ = _twice(text_of[:-2][at_], triples[at_])
        for k in range(3):
            repeated[at_[many] + k] = True
    # lines: a text's bytes between newlines
    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    line_text = np.searchsorted(at, line_start, "right") - 1
    newline_ends = np.isin(line_start, breaks + 1)
    # a newline at a text's end begins an empty line of that text, not the next one's first
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - np.append(newline_ends[1:], False)
    line_end = np.minimum(np.maximum(line_end, line_start), len(data))
    held = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_text = line_start[held], line_end[held], line_text[held]
    _, new_line = _twice(line_text, _codes(data, line_start, line_end))
    return {
        "n_words": n_words.astype(np.int64), "word_chars": chars, "n_symbols": _within(data, at, SYMBOLS), "n_dup_lines": _per(line_text, ~new_line, n), "n_repeat_words": _per(text_of, repeated, n), "n_lines": np.bincount(line_text, minlength=n).astype(np.int64),
        "n_upper": _within(data, at, _UPPER), "n_letters": _within(data, at, _UPPER | _LOWER), "n_marks": _within(data, at, _MARKS), "n_digits": _within(data, at, _DIGITS), "n_distinct": _per(text_of, new, n),
    }


def _count_task(batches: Iterator[pa.RecordBatch], text: int, keep: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(text)
        parts = [count(texts[lo:hi]) for lo, hi in portions(texts)]
        made = [pa.array(np.concatenate([x[c] for x in parts]) if parts else [], pa.int64()) for c in COUNTS]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *made], names=names)


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of all rows, and COUNTS as `__q_n_words` and so on."""
    from_ = docs.select("text", *(c for c in keep if c != "text"))
    made = [f"__q_{c}" for c in COUNTS]
    at = [from_.columns.index(c) for c in keep]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in made)])
    return from_.mapInArrow(lambda batches: _count_task(batches, 0, at, [*keep, *made]), schema)


def ratio(name: str) -> Column:
    """A ratio of the counts; nothing over nothing is 0."""
    over, under = RATIOS[name]
    value = F.col(f"__q_{over}").cast("double")
    return value / F.greatest(F.lit(1), F.col(f"__q_{under}")) if under else value


def base_failed() -> Column:
    return (F.col("__q_n_words") < 50) | (100 * F.col("__q_n_repeat_words") > 50 * F.col("__q_n_words"))


def _covers(rule: list[Condition], rows: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, side, limit in rule:
        out &= rows[name] >= limit if side == ">=" else rows[name] <= limit
    return out


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray, conditions: int, cuts: int) -> list[Condition]:
    rule: list[Condition] = []
    here = np.ones(len(bad), bool)
    while len(rule) < conditions and (~bad[here]).any():
        p0, n0 = int(bad[here].sum()), int((~bad[here]).sum())
        best, gain = None, 1e-9
        for name, values in rows.items():
            limits = np.unique(np.quantile(values[here], np.linspace(0, 1, cuts)))
            for side in (">=", "<="):
                inside = values[here][None, :] >= limits[:, None] if side == ">=" else values[here][None, :] <= limits[:, None]
                p, n = (inside & bad[here]).sum(axis=1), (inside & ~bad[here]).sum(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    own = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1)
                if own.max() > gain:
                    gain, best = own.max(), (name, side, float(limits[own.argmax()]))
        if best is None:
            break
        rule.append(best)
        here &= _covers([best], rows, len(bad))
    return rule


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 16, conditions: int = 4, cuts: int = 48, precision: float = 0.97, support: int = 8) -> list[list[Condition]]:
    """An ordered list of conjunctions; what meets one is to be rejected. Every third row is held back for pruning."""
    rules: list[list[Condition]] = []
    held = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        grow, prune = left & ~held, left & held
        if bad[grow].sum() < support or bad[prune].sum() < support // 2:
            break
        rule = _grow({k: v[grow] for k, v in rows.items()}, bad[grow], conditions, cuts)
        own, own_bad = {k: v[prune] for k, v in rows.items()}, bad[prune]
        tried = []
        for k in range(len(rule), 0, -1):
            hit = _covers(rule[:k], own, len(own_bad))
            p, n = int((hit & own_bad).sum()), int((hit & ~own_bad).sum())
            tried.append(((p - n) / (p + n) if p + n else -1.0, -k, p, n))
        if not tried:
            break
        _, k, p, n = max(tried)
        if p < support // 2 or p < precision * (p + n):
            break
        rules.append(rule[:-k])
        left &= ~_covers(rules[-1], rows, len(bad))
    return rules


def expression(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that a row meets, from 1; 0 if none."""
    out = None
    for k, rule in enumerate(rules, 1):
        met = F.lit(True)
        for name, side, limit in rule:
            met = met & (ratio(name) >= limit if side == ">=" else ratio(name) <= limit)
        out = F.when(met, k) if out is None else out.when(met, k)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """Learns the list from at most `sample` labelled rows that pass the base rules."""
    first = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__q_good")).orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample)
    own = docs.select("doc_id", "text").join(F.broadcast(first.withColumnRenamed("doc_id", "__q_id")), F.col("doc_id") == F.col("__q_id"))
    rows = counted(own, ["doc_id", "__q_good"]).where(~base_failed()).select("doc_id", "__q_good", *(ratio(k).alias(k) for k in RATIOS)).orderBy("doc_id", *RATIOS).limit(2 * sample).toPandas()
    return learn({k: rows[k].to_numpy() for k in RATIOS}, rows["__q_good"].to_numpy() == 0)


def judged(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """doc_id, the counts, base_failed, kept and `rule` (the list's rule that rejects it, or 0) of every row."""
    own = counted(docs, ["doc_id"]).withColumn("rule", expression(rules))
    counts = [F.col(f"__q_{c}").alias(c) for c in COUNTS[:5]]
    return own.select("doc_id", *counts, base_failed().alias("base_failed"), (~base_failed() & (F.col("rule") == 0)).alias("kept"), "rule")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that pass the base rules and the learned list, with their columns."""
    rules = fit(docs, labels, sample)
    return counted(docs, docs.columns).where(~base_failed() & (expression(rules) == 0)).select(*docs.columns)
