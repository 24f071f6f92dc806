"""Byte-level BPE ids of a whole corpus by merge replay (problem 6).

Texts stay in Arrow's buffers. Each task cuts its slice of the corpus into pieces by array operations on code point classes, keeps
each different piece once, and replays the vocabulary's merges over these: an inverted index from merge ranks to the positions of
symbol pairs is worked off in rank order, and a merge touches only the pairs to its left and right. The pieces' ids are then
laid out per document. Pieces do not depend on one another, so slices need no exchange and any cut gives the same ids.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.session import spread

#: Folder of the public vocabulary files; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: A slice ends after about this many bytes of text (a document is never cut). Bounds memory; no result depends on it.
SLICE_BYTES = 4 << 20

_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
_NONE = np.int32(2**31 - 1)
_BAND = 512


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point: letter, number, white space, other."""
    import regex

    table = np.full(0x110000, _OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    where = np.array(points)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\p{White_Space}+", _SPACE)):
        for m in regex.finditer(pattern, text):
            table[where[m.start() : m.end()]] = kind
    return table


class Vocabulary:
    """Merges by rank. ``pair_keys`` is sorted; ``pair_rank`` and ``pair_id`` belong to it."""

    def __init__(self, path: str):
        whole = json.load(open(path, encoding="utf-8"))
        model = whole["model"]
        self._refuse(path, whole)
        vocab, merges = model["vocab"], model["merges"]
        # The printable stand-ins of bytes: visible bytes for themselves, the others in order from 256 on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        self.byte_ids = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        ids = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank, self.id_of_rank = keys[order], order.astype(np.int32), ids
        first = self.byte_ids
        self.byte_pair_rank = self.rank(np.repeat(first, 256), np.tile(first, 256))
        self.bands = len(pairs) // _BAND + 1

    @staticmethod
    def _refuse(path: str, whole: dict) -> None:
        """ValueError for a vocabulary whose texts are prepared or cut otherwise than here, as its ids would come out wrong."""
        model, cut = whole["model"], whole.get("pre_tokenizer") or {}
        wrong = [
            name
            for name, bad in (
                ("model type", model.get("type", "BPE") != "BPE"),
                ("normalizer", whole.get("normalizer") is not None),
                ("pre-tokenizer", (cut.get("type"), cut.get("add_prefix_space", True), cut.get("use_regex", True)) != ("ByteLevel", False, True)),
                ("subword prefix", bool(model.get("continuing_subword_prefix"))),
                ("end-of-word suffix", bool(model.get("end_of_word_suffix"))),
                ("dropout", bool(model.get("dropout"))),
                ("ignored merges", bool(model.get("ignore_merges"))),
                ("byte fallback", bool(model.get("byte_fallback"))),
            )
            if bad
        ]
        if wrong:
            raise ValueError(f"{path}: not supported here: {', '.join(wrong)}")

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair of ids, or _NONE."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], _NONE)


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def piece_starts(data: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pieces of the texts begin: contractions, letters, numbers and others with a space before, white space.

    ``data`` holds the UTF-8 of all texts, ``doc_starts`` the offsets of the non-empty ones.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b0 = data[lead].astype(np.int32)
    if len(lead) < n:
        many = np.flatnonzero(b0 >= 0xC0)
        lead_m, f = lead[many], b0[many]
        nxt = lambda k: data[np.minimum(lead_m + k, n - 1)].astype(np.int32) & 0x3F
        two = (f & 0x1F) << 6 | nxt(1)
        three = (f & 0x0F) << 12 | nxt(1) << 6 | nxt(2)
        four = (f & 0x07) << 18 | nxt(1) << 12 | nxt(2) << 6 | nxt(3)
        b0[many] = np.minimum(np.where(f < 0xE0, two, np.where(f < 0xF0, three, four)), 0x10FFFF)
    kind = _classes()[b0]
    m = len(kind)
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first = first[lead]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # White space before something of the same text: its last character stands alone, or joins what follows if it is a plain space.
    ends = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:])
    start[ends] = True
    start[ends[b0[ends] == 0x20] + 1] = False
    # Contractions, where a piece begins with an apostrophe.
    quote = np.flatnonzero((b0 == 0x27) & start)
    if len(quote):
        one = np.append(b0, [0, 0])
        fresh = np.append(first, [True, True])
        c1, c2 = np.where(fresh[quote + 1], 0, one[quote + 1]), np.where(fresh[quote + 1] | fresh[quote + 2], 0, one[quote + 2])
        single = np.isin(c1, [ord(c) for c in "stmd"])
        double = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        start = np.append(start, [True, True])
        for which, length in ((single, 1), (double, 2)):
            p = quote[which]
            start[p + 1] = False
            start[np.minimum(p + 1 + length, m)] = True
        start = start[:m]
    return lead[start]


def replay(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words (bytes data[offsets[i]:offsets[i+1]]), as (ids of all words in order, offsets of the words' ids)."""
    n, words = len(data), len(offsets) - 1
    sym = vocab.byte_ids[data]
    word = np.repeat(np.arange(words, dtype=np.int32), np.diff(offsets))
    nxt = np.arange(1, n + 1, dtype=np.int32)
    prv = np.arange(-1, n - 1, dtype=np.int32)
    if n:
        stops = offsets[1:][np.diff(offsets) > 0] - 1
        nxt[stops] = -1
        prv[offsets[:-1][np.diff(offsets) > 0]] = -1
    rank = np.full(n, _NONE, np.int32)
    if n > 1:
        rank[:-1] = np.where(nxt[:-1] >= 0, vocab.byte_pair_rank[data[:-1].astype(np.int32) << 8 | data[1:]], _NONE)
    index: list[list[np.ndarray]] = [[] for _ in range(vocab.bands + 1)]

    def enter(at: np.ndarray) -> None:
        """Positions to the lists of their ranks' bands."""
        band = rank[at] // _BAND
        order = np.argsort(band, kind="stable")
        at, band = at[order], band[order]
        cuts = np.flatnonzero(np.diff(band)) + 1
        for part in np.split(at, cuts) if len(at) else ():
            index[rank[part[0]] // _BAND].append(part)

    enter(np.flatnonzero(rank != _NONE))
    alive = np.ones(n, bool)
    for b in range(vocab.bands):
        if not index[b]:
            continue
        stop, todo = (b + 1) * _BAND, np.unique(np.concatenate(index[b]))
        index[b] = []
        while len(todo := todo[rank[todo] < stop]):
            # The pairs of the lowest rank of each word, from the left and without overlap.
            r, w = rank[todo], word[todo]
            heads = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            low = np.repeat(np.minimum.reduceat(r, heads), np.diff(np.append(heads, len(todo))))
            p = todo[r == low]
            joined = np.append(False, nxt[p[:-1]] == p[1:])
            if joined.any():
                k = np.arange(len(p))
                p = p[(k - np.maximum.accumulate(np.where(joined, 0, k))) % 2 == 0]
            q = nxt[p]
            sym[p] = vocab.id_of_rank[rank[p]]
            alive[q] = False
            rank[q] = _NONE
            after = nxt[q]
            nxt[p] = after
            inner = after >= 0
            prv[after[inner]] = p[inner]
            # Only the touched neighbours get new pairs.
            rank[p] = _NONE
            a, c = p[inner], after[inner]
            rank[a] = vocab.rank(sym[a], sym[c])
            left = prv[p]
            has = left >= 0
            l, a2 = left[has], p[has]
            rank[l] = vocab.rank(sym[l], sym[a2])
            new = np.unique(np.concatenate([a, l]))
            new_rank = rank[new]
            enter(new[(new_rank >= stop) & (new_rank != _NONE)])
            near = new[new_rank < stop]
            todo = np.union1d(todo, near) if len(near) else todo
    counts = np.bincount(word[alive], minlength=words) if n else np.zeros(words, np.int64)
    return sym[alive], np.append(0, np.cumsum(counts))


def encode_buffers(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts given as UTF-8 data and offsets, as (ids, offsets per text). Equal pieces of the slice are encoded once."""
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets.astype(np.int64) - base
    starts = piece_starts(data, offsets[:-1][np.diff(offsets) > 0])
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    bounds = np.append(starts, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(
        pa.binary(),
        len(starts),
        [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))],
    ).dictionary_encode()
    which, words = pieces.indices.to_numpy(), pieces.dictionary
    _, word_offsets, word_data = words.buffers()
    word_offsets = np.frombuffer(word_offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    ids, at = replay(np.frombuffer(word_data, np.uint8)[: word_offsets[-1]], word_offsets.astype(np.int64), vocab)
    count = np.diff(at)[which]
    ends = np.cumsum(count)
    out = ids[np.repeat(at[which] - (ends - count), count) + np.arange(int(ends[-1]))]
    before = np.append(0, ends)
    return out, before[np.searchsorted(starts, offsets, side="left")]


def _slices(column: pa.Array, size: int):
    """(first row, rows, data, offsets) of runs of rows with about ``size`` bytes of text; nulls are empty texts."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
        yield i, j - i, data, offs[i : j + 1]
        i = j


def encode_corpus(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizers: str = TOKENIZERS,
    vocabulary_file: str = VOCABULARY,
    counts_only: bool = False,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """(key, ids) of every document, without special tokens; with ``counts_only`` (key, n_tokens) instead.

    The ids of an empty and of a null text are an empty list. Text that looks like a special token is plain text. Repeated rows give
    repeated results, a null key stays null; only the two named columns are read. One pass, no shuffle.
    A vocabulary with other settings than those of a plain byte-level one is refused (ValueError), here and not first in a task.
    """
    path = f"{tokenizers}/{vocabulary_file}"
    vocabulary(path)

    def encode(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for i, n, data, offs in _slices(batch.column(1), slice_bytes):
                ids, at = encode_buffers(data, offs, vocab)
                if counts_only:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(np.diff(at))], ["k", "v"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), lists], ["k", "v"])

    rows = spread(documents.select(documents[key].alias("k"), documents[text].alias("t")))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(encode, f"k {kind}, v {'bigint' if counts_only else 'array<int>'}").toDF(key, "n_tokens" if counts_only else "ids")
