"""Token ids of whole texts by the tokenizers library, each distinct stretch of a batch encoded once."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from loomlog.llm.shared import BLANK, ragged, raw

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: Bytes of text that a task encodes at once: the more, the more of its stretches are repeats.
ENCODE_BYTES = 4 << 20
#: Bytes that a worker's known stretches and their ids take at most, over all of its tasks.
KNOWN_BYTES = 16 << 20
#: Bytes that a known stretch costs beside its own and its ids' (an offset each).
_ENTRY = 16
#: Bytes of a stretch and its ids from which on it isn't kept.
_LONG = 190

_BYTE = np.arange(256)
_LETTER = np.isin(_BYTE | 0x20, np.arange(0x61, 0x7B)) & (_BYTE < 0x80)
_MARK = np.isin(_BYTE, np.frombuffer(b".,!#$%&*?;:)(-\"", np.uint8))
#: ASCII that isn't white space or a control; beyond it, bytes that may end a white space character need a look.
_ENDS = ((_BYTE > 0x20) & (_BYTE < 0x7F)) | (_BYTE >= 0x80)
_MAY_END_SPACE = np.isin(_BYTE, [0x85, 0x9F, *range(0x80, 0x8B), 0xA0, 0xA8, 0xA9, 0xAF])
_MAY_BEGIN_SPACE = np.isin(_BYTE, [0xC2, 0xE1, 0xE2, 0xE3])
_STARTS = _ENDS & ~_MAY_BEGIN_SPACE
#: White space in ASCII, as str.isspace() has it.
_SPACE = np.isin(_BYTE, [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)])


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer, and the number of bytes that each id stands for."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return own, np.array([len(own.id_to_token(k) or "") for k in range(own.get_vocab_size())], np.int64)


@lru_cache(maxsize=4)
def added(path: str) -> tuple[str, ...]:
    """Texts that the tokenizer takes out before it splits: what stands beside them is split on its own."""
    return tuple(x.content for x in tokenizer(path)[0].get_added_tokens_decoder().values())


def cuts(data: np.ndarray) -> np.ndarray:
    """Where byte-level BPE surely starts a new stretch, whatever stands around it.

    The vocabulary's split pattern lets a stretch begin with one space but never run on into white space:
    a cut is made at a lone space or newline between two other characters (next to what may be white space
    beyond ASCII, none is made). Nor does a run of letters go on into a mark.
    """
    if len(data) < 3:
        return np.zeros(0, np.int64)
    lone = np.flatnonzero((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) + 1
    last, after = data[lone - 1], data[lone + 1]
    clear = _ENDS[last] & ~BLANK[last] & _STARTS[after] & ~BLANK[after]
    look = np.flatnonzero(clear & _MAY_END_SPACE[last])
    two, three = data[np.maximum(lone[look] - 2, 0)], data[np.maximum(lone[look] - 3, 0)]
    clear[look] = (two != 0xC2) & ((three < 0xE1) | (three > 0xE3))
    marks = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
    return np.concatenate([lone[clear], marks])


def _plain(x: str) -> bool:
    return not x[-1].isspace() and (not x[0].isspace() or x[0] in " \n" and len(x) > 1 and not x[1].isspace())


def _all_plain(stretches: pa.Array) -> np.ndarray:
    """_plain() of each: by their bytes, only those that may hold white space beyond ASCII there are looked at as text."""
    data, at = raw(stretches)
    first, end = at[:-1], at[1:]
    head, second, last = data[first], data[np.minimum(first + 1, end - 1)], data[end - 1]
    led = (head == 0x20) | (head == 0x0A)
    plain = ~_SPACE[last] & (~_SPACE[head] | led & (end - first > 1) & ~_SPACE[second])
    tail = _MAY_END_SPACE[last] & (last >= 0x80)
    before, third = data[np.maximum(end - 2, 0)], data[np.maximum(end - 3, 0)]
    tail &= (before == 0xC2) | (third >= 0xE1) & (third <= 0xE3)
    for k in np.flatnonzero(plain & (tail | _MAY_BEGIN_SPACE[head] | led & _MAY_BEGIN_SPACE[second])).tolist():
        plain[k] = _plain(stretches[k].as_py())
    return plain


def _encode_each(stretches: pa.Array, path: str, alone: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all stretches in a row, and how many each has.

    Stretches go to the tokenizer joined by newlines, which saves a call each; the bytes that ids stand for
    tell them apart again. Those that begin or end in unusual white space, or hold one of `alone`, go by themselves.
    """
    own, width = tokenizer(path)
    plain = _all_plain(stretches)
    for token in alone:
        plain &= ~pc.match_substring(stretches, token).to_numpy(zero_copy_only=False)
    order, n = np.argsort(~plain, kind="stable"), int(plain.sum())
    parts: list[np.ndarray] = []
    counts = np.zeros(len(stretches), np.int64)
    data, at = raw(stretches.filter(pa.array(plain)))
    ended = np.full(len(data) + n, 0x0A, np.uint8)  # each plain stretch and a newline
    inside = np.ones(len(ended), bool)
    inside[at[1:] + np.arange(n)] = False
    ended[inside] = data
    for k in range(0, n, 2000):
        to = min(k + 2000, n)
        sizes = np.diff(at[k : to + 1])
        joined = ended[at[k] + k : at[to] + to - 1].tobytes().decode()
        ids = np.array(own.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(width[ids])
        stop = np.cumsum(sizes + 1) - 1
        last = np.searchsorted(ends, stop)
        first = np.searchsorted(ends, stop - sizes, "right")
        if not (np.array_equal(ends[last], stop) and ends[-1] == stop[-1]):
            raise ValueError("this vocabulary does not keep stretches apart")
        counts[order[k:to]] = last - first + 1
        parts.append(ids[ragged(first, last - first + 1)])
    single = order[n:]
    for k, coded in zip(single.tolist(), own.encode_batch_fast(stretches.take(pa.array(single)).to_pylist(), add_special_tokens=False), strict=True):
        parts.append(np.array(coded.ids, np.uint32))
        counts[k] = len(parts[-1])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    begin = np.zeros(len(stretches), np.int64)
    begin[order] = np.cumsum(counts[order]) - counts[order]
    return flat[ragged(begin, counts)], counts


class Known:
    """Stretches that a worker has met, with their ids: the first ones, as frequent ones come early, while they take
    no more than `limit` bytes. Both are Arrow arrays, which hold several times as many as a dict does."""

    def __init__(self, limit: int = KNOWN_BYTES) -> None:
        self.stretches = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_list(pa.uint32()))
        self.left = limit

    def encode(self, stretches: pa.Array, path: str, alone: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """The same as _encode_each(), asking the tokenizer only for what isn't known. `stretches` are distinct."""
        place = np.full(len(stretches), -1, np.int64)
        if len(self.stretches):
            met = pc.index_in(self.stretches, value_set=stretches)
            which = np.flatnonzero(met.is_valid().to_numpy(zero_copy_only=False))
            place[met.drop_null().to_numpy()] = which
        missing = np.flatnonzero(place < 0)
        new = stretches.take(pa.array(missing))
        flat, counts = _encode_each(new, path, alone)
        # the ids of all known stretches, then those of the new ones
        at = np.concatenate([self.ids.offsets.to_numpy(), len(self.ids.values) + np.cumsum(counts)])
        pool = np.concatenate([self.ids.values.to_numpy(), flat])
        place[missing] = len(self.ids) + np.arange(len(missing))
        if self.left > 0:
            self._keep(new, flat, counts)
        long = at[place + 1] - at[place]
        return pool[ragged(at[place], long)], long

    def _keep(self, new: pa.Array, flat: np.ndarray, counts: np.ndarray) -> None:
        cost = pc.binary_length(new).to_numpy() + 4 * counts
        short = np.flatnonzero(cost < _LONG)
        total = np.cumsum(cost[short] + _ENTRY)
        n = int(np.searchsorted(total, self.left, "right"))
        kept = short[:n]
        if n:
            at = np.concatenate([[0], np.cumsum(counts)])
            ids = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(counts[kept])]), flat[ragged(at[kept], counts[kept])])
            self.stretches = pa.concat_arrays([self.stretches, new.take(pa.array(kept))])
            self.ids = pa.concat_arrays([self.ids, ids])
        self.left = 0 if n < len(short) else self.left - int(total[-1]) if n else self.left


@lru_cache(maxsize=1)
def known(path: str) -> Known:
    """What this worker knows of the vocabulary at `path`."""
    return Known()


def _holding(texts: pa.Array, path: str) -> list[int]:
    """Numbers of the texts that hold an added token's text."""
    hit = np.zeros(len(texts), bool)
    for token in added(path):
        hit |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
    return np.flatnonzero(hit).tolist()


def encode(texts: pa.Array, path: str, end_id: int, met: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each followed by `end_id`, and the offsets of each text. Null is empty.

    A text that holds an added token's text is one stretch, which goes to the tokenizer by itself.
    """
    data, at = raw(texts)
    marked = np.zeros(len(data) + 1, bool)
    marked[cuts(data)] = True
    whole = _holding(texts, path)
    for k in whole:
        marked[at[k] : at[k + 1]] = False
    marked[at] = True
    bounds = np.flatnonzero(marked)
    stretch_at = np.cumsum(marked)[at] - 1
    del marked
    coded = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    which = coded.indices.to_numpy()
    flat, long = (met or known(path)).encode(coded.dictionary, path, added(path) if whole else ())
    del bounds, coded
    begin = np.cumsum(long) - long
    text_at = np.concatenate([[0], np.cumsum(long[which])])[stretch_at] + np.arange(len(texts) + 1)
    out = np.full(int(text_at[-1]), end_id, np.uint32)
    for lo in range(0, len(texts), 256):
        hi = min(lo + 256, len(texts))
        own = which[stretch_at[lo] : stretch_at[hi]]
        ids = flat[ragged(begin[own], long[own])]
        gaps = np.zeros(text_at[hi] - text_at[lo], bool)
        gaps[text_at[lo + 1 : hi + 1] - 1 - text_at[lo]] = True
        out[text_at[lo] : text_at[hi]][~gaps] = ids
    return out, text_at
