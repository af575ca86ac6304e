"""Passages of a text and their features, vectorised over a slice of rows.

A passage is described by its bytes (shares of classes), its lengths and repetitions, and its words (shares
of hash buckets)."""

from __future__ import annotations

import numpy as np

from .arrays import IS_WHITE, mix, run_hashes, runs

PASSAGE_WORDS = 64

# Classes of bytes whose shares describe a passage.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".", ",", "!", "?", "#", "$", "%", "&", "*", "|", "<>", "@", ":;", "-_", "\"'()[]{}", "/=\\", "+~^`"]
N_CLASSES = len(_CLASSES) + 3
CLASS_OF = np.zeros(256, np.int64)
CLASS_OF[0x80:0xC0] = N_CLASSES - 1
CLASS_OF[0xC0:] = N_CLASSES - 2
for _k, _chars in enumerate(_CLASSES, 1):
    CLASS_OF[[ord(c) for c in _chars]] = _k
WORD_BUCKETS = 64
N_SURFACE = N_CLASSES + 5
N_FEATURES = N_SURFACE + WORD_BUCKETS


def word_bucket(word: bytes) -> int:
    return int(run_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0] >> np.uint64(40)) % WORD_BUCKETS


def _share_first_seen(keys: np.ndarray, groups: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    """Per passage: share of keys that occur for the first time in their group."""
    _, first = np.unique(mix(groups.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ keys), return_index=True)
    return np.bincount(passage[first], minlength=n) / np.maximum(np.bincount(passage, minlength=n), 1)


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features [passages, N_FEATURES], row of each passage); passages are runs of 64 words.

    A row without words has one passage whose features are 0."""
    rows = len(offsets) - 1
    starts, ends, row = runs(~IS_WHITE[data], offsets)
    if not len(starts):
        return np.zeros((rows, N_FEATURES), np.float32), np.arange(rows)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(count)))
    place = np.arange(len(starts)) - first[row]
    per_row = -(-count // PASSAGE_WORDS)
    base = np.concatenate(([0], np.cumsum(np.maximum(per_row, 1))))
    passage = base[row] + place // PASSAGE_WORDS
    n = int(base[-1])
    owner = np.repeat(np.arange(rows), np.maximum(per_row, 1))
    # Bytes from a passage's first word to its last.
    new = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    begin, end = starts[new], ends[np.concatenate((new[1:] - 1, [len(ends) - 1]))]
    marks = np.zeros(len(data) + 1, np.int64)
    np.add.at(marks, begin, 1)
    np.add.at(marks, end, -1)
    inside = np.cumsum(marks[:-1]) > 0
    order = np.searchsorted(begin, np.flatnonzero(inside), "right") - 1
    shares = np.bincount(passage[new][order] * N_CLASSES + CLASS_OF[data[inside]], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    size = np.maximum(shares.sum(1, keepdims=True), 1)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :N_CLASSES] = np.sqrt(shares / size)
    words = np.bincount(passage, minlength=n)
    h = run_hashes(data, starts, ends)
    out[:, N_CLASSES] = np.bincount(passage, ends - starts, n) / np.maximum(words, 1) / 10
    out[:, N_CLASSES + 1] = np.log1p(words) / 4
    out[:, N_CLASSES + 2] = _share_first_seen(h, passage, passage, n)
    nearby = np.concatenate((h[1:], [np.uint64(0)]))
    pair = mix(h + nearby * np.uint64(0xD1342543DE82EF95))
    out[:, N_CLASSES + 3] = _share_first_seen(pair, row, passage, n)
    out[:, N_CLASSES + 4] = np.log1p(count)[owner] / 8
    buckets = (h >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
    held = np.bincount(passage * WORD_BUCKETS + buckets, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
    out[:, N_SURFACE:] = np.sqrt(held / np.maximum(words, 1)[:, None])
    return out, owner
