"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seeded generator. A letter trigram is bound
from the vectors of its letters, permuted by their places (rotated by two, by one, not at all) and
multiplied; a document bundles its trigrams' vectors, damped by the logarithm of their counts (in sixteenths, so
that sums are whole numbers and the same in any order and any split of the input). A language's prototype bundles the unit vectors of its documents; the mean of all prototypes is taken off,
and a document gets the language with the nearest prototype by cosine.

Prototypes are summed in each task, then in two steps by language, in whole numbers, so the order of tasks
does not matter. They are one vector a language: that is all that reaches the driver and the tasks.

Defined results: a null text, and one without any letter, is `und` with score 0, as is everything when
nothing could be learned; rows without doc_id are judged, never learned from and not held out; equal
cosines go to the first language by code point; repeated rows count each time; an empty table gives no
rows; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.shared import portions

SIZE = 1024
SEED = 8
SYMBOLS = 1021
UNKNOWN = "und"
_SCALE = 1 << 16
_GRAMS = 1 << 13


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Is a code point a letter."""
    return np.array([chr(k).isalpha() if not 0xD800 <= k < 0xE000 else False for k in range(0x110000)])


@lru_cache(maxsize=2)
def letter_vectors(size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A vector for each symbol (0 stands between words), as it is used in the first, second and third place."""
    own = np.random.default_rng(seed).integers(0, 2, (SYMBOLS + 1, size), dtype=np.int8) * 2 - 1
    return np.roll(own, 2, axis=1), np.roll(own, 1, axis=1), own


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, count) of all texts, by text; a trigram is three symbols of ten bits."""
    low = [f" {x.lower()} " for x in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    symbol = np.where(_letters()[points], points % SYMBOLS + 1, 0)
    text = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)))
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0) | (text[1:] != text[:-1])
    symbol, text = symbol[keep].astype(np.int64), text[keep]
    gram = (symbol[:-2] << 20) | (symbol[1:-1] << 10) | symbol[2:]
    inside = text[:-2] == text[2:]
    order = np.sort((text[:-2][inside] << 30) | gram[inside])
    first = np.flatnonzero(np.diff(order, prepend=-1))
    return order[first] >> 30, order[first] & ((1 << 30) - 1), np.diff(np.append(first, len(order)))


def encode(texts: list[str], size: int = SIZE, seed: int = SEED) -> np.ndarray:
    """The bundled vector of each text, of length 1; zero where it has no letter."""
    out = np.zeros((len(texts), size))
    text, gram, count = trigrams(texts)
    weight = np.rint(16 * (1 + np.log(count))).astype(np.float32)
    used, code = np.unique(gram, return_inverse=True)
    first, second, third = letter_vectors(size, seed)
    for lo in range(0, len(used), _GRAMS):
        own = used[lo : lo + _GRAMS]
        vectors = (first[own >> 20] * second[(own >> 10) & 1023] * third[own & 1023]).astype(np.float32)
        here = np.flatnonzero((code >= lo) & (code < lo + _GRAMS)) if len(used) > _GRAMS else slice(None)
        t, c, w = text[here], code[here] - lo, weight[here]
        at = np.flatnonzero(np.diff(t, prepend=-1))
        for a, b in zip(at, np.append(at[1:], len(t)), strict=True):
            out[t[a]] += w[a:b] @ vectors[c[a:b]]  # whole numbers below 2^24: single precision is exact
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learn_task(batches: Iterator[pa.RecordBatch], size: int, seed: int) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1)
        for lo, hi in portions(texts):
            vectors = np.rint(encode([x or "" for x in texts[lo:hi].to_pylist()], size, seed) * _SCALE).astype(np.int64)
            for lang in set(langs[lo:hi]):
                sums[lang] = sums.get(lang, 0) + vectors[langs[lo:hi] == lang].sum(axis=0)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "sums"])


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.asarray(x, np.int64) for x in group["sums"])
    return pd.DataFrame({"lang": [group["lang"].iloc[0]], "sums": [total.tolist()]})


def learn(docs: DataFrame, size: int = SIZE, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from text and lang of the rows that aren't held out."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    parts = rows.mapInArrow(lambda batches: _learn_task(batches, size, seed), "lang string, sums array<bigint>")
    some = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("lang", "salt").applyInPandas(_add, "lang string, sums array<bigint>")
    found = sorted(some.groupBy("lang").applyInPandas(_add, "lang string, sums array<bigint>").collect(), key=lambda r: r["lang"])
    own = np.array([r["sums"] for r in found], np.float64).reshape(len(found), size)
    length = np.linalg.norm(own, axis=1, keepdims=True)
    own = np.divide(own, length, out=np.zeros_like(own), where=length > 0)
    if len(own) > 1:
        own -= own.mean(axis=0)
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    return [r["lang"] for r in found], own.astype(np.float32)


def _predict_task(batches: Iterator[pa.RecordBatch], langs: list[str], prototypes: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    names = np.array([*langs, UNKNOWN], object)
    for batch in batches:
        texts = batch.column(2)
        best, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
        for lo, hi in portions(texts):
            vectors = encode([x or "" for x in texts[lo:hi].to_pylist()], prototypes.shape[1], seed)
            some = np.flatnonzero(vectors.any(axis=1))
            if len(some) and len(langs):
                cosine = np.stack([(vectors[some] * x).sum(axis=1) for x in prototypes], axis=1)  # row by row: a matrix product would depend on the portion
                best[lo + some] = cosine.argmax(axis=1)
                score[lo + some] = np.clip((1 + cosine.max(axis=1)) / 2, 0, 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from its text alone."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(lambda batches: _predict_task(batches, langs, prototypes, seed), "doc_id long, held_out boolean, lang_pred string, score double")
