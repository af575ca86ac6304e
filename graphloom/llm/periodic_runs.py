"""Operator 11: periodic runs of words, found by block convolution.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
max(MIN_WORDS, MIN_REPEATS * q) words long, that no neighbouring word extends.  At every dyadic scale P the
periods in (P/2, P] are searched: a run of such a period holds one whole block of the grid of P/2 words
in its first P words, and the same block again q words later.  The sums of squared differences of a block and all
places q = P/2+1 .. P words after it come from one number-theoretic convolution a block; where the sum is
zero, q is a seed.  A seed grows to both sides as far as words q apart agree, and long enough stretches are runs.

Words enter the convolution as small numbers (bits of a hash of the word, at most sqrt(65536 / block)), so that
every sum of squares is an integer below the modulus 65537 and is exact; a zero of different words
fails when it grows.  Transforms are matrix products of at most 64 terms in doubles, which hold them exactly.

Defined cases: a null or blank text has no word and no run; documents without words, repeated rows and
further columns are kept as they are; an empty table gives an empty result.  Memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import RunHasher, mix

MIN_WORDS, MIN_REPEATS = 6, 4
#: Longest block; at larger scales a block of this length is compared with several tiles of places.
MAX_BLOCK = 2048
#: Words of documents that are searched together; a longer document is taken alone.
GROUP_WORDS = 200_000
#: Numbers in a matrix of rows that are transformed together.
CELLS = 1 << 16

MODULUS = 65537  # prime; 3 generates its group of 65536 elements
GENERATOR = 3


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo MODULUS, in place; a multiple of it may give MODULUS itself."""
    q = np.floor(x * (1.0 / MODULUS))
    q *= MODULUS
    x -= q
    return x


@lru_cache(maxsize=1)
def generated() -> np.ndarray:
    """GENERATOR^i modulo MODULUS for i below 65536."""
    table = np.ones(1, np.int64)
    while len(table) < 65536:
        table = np.concatenate([table, table * pow(GENERATOR, len(table), MODULUS) % MODULUS])
    return table


def _powers(step: int, rows: int, columns: int, scale: int = 1) -> np.ndarray:
    """scale * GENERATOR^(step * i * j) modulo MODULUS."""
    return (generated()[step * np.outer(np.arange(rows), np.arange(columns)) % 65536] * scale % MODULUS).astype(np.float64)


class Transform:
    """Number-theoretic transform of rows of `size` numbers, a power of two up to 4096, in one or two matrix products.

    Transformed rows stay in the order of the products; number n2 * i + j of a row is cell (i, j) of the first one."""

    def __init__(self, size: int):
        self.first = a = 1 if size <= 64 else size // 64
        self.second = b = size // a
        tables = lambda step, scale: (_powers(step * b, a, a), _powers(step, a, b), _powers(step * a, b, b, scale))
        root = 65536 // size
        self.forward, self.mirrored, self.inverse = tables(root, 1), tables(-root, 1), tables(-root, pow(size, -1, MODULUS))

    def __call__(self, x: np.ndarray, mirrored: bool = False) -> np.ndarray:
        """Transform of rows of small numbers (whose sums of 64 times 2^32 are below 2^53); missing columns are zeros.

        mirrored: with the inverse root, so that a product with it correlates instead of convolving."""
        rows, twist, columns = self.mirrored if mirrored else self.forward
        if self.first == 1:
            return reduced(x @ columns[: x.shape[1]])
        x = x.reshape(len(x), -1, self.second)
        x = np.matmul(rows[:, : x.shape[1]], x)
        x *= twist
        return reduced(reduced(x) @ columns)

    def undo(self, x: np.ndarray, most: int) -> np.ndarray:
        """The first `most` numbers of each row, half of them at least."""
        rows, twist, columns = self.inverse
        if self.first == 1:
            return reduced(x @ columns[:, :most])
        x = reduced(x @ columns)
        x *= twist
        return reduced(np.matmul(rows[: most // self.second], reduced(x))).reshape(len(x), -1)


@lru_cache(maxsize=None)
def transform(size: int) -> Transform:
    return Transform(size)


def zero_mismatches(values: np.ndarray, squares: np.ndarray, starts: np.ndarray, block: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of every block values[x:x+block] that recurs at a distance in offset .. offset+block-1.

    values must reach 3 * block + offset beyond the last start; squares are the running sums of their squares."""
    size = 2 * block
    ntt = transform(size)
    windows, blocks, sums = sliding_window_view(values, size), sliding_window_view(values, block), sliding_window_view(squares, block)
    found = []
    step = max(1, CELLS // size)
    for at in range(0, len(starts), step):
        x = starts[at : at + step]
        product = ntt(windows[x + offset])
        product *= ntt(blocks[x], mirrored=True)
        cross = ntt.undo(reduced(product), block)
        cross *= 2.0
        cross[cross == 2.0 * MODULUS] = 0.0
        energy = sums[x + offset + block]
        energy -= sums[x + offset]
        energy += (squares[x + block] - squares[x])[:, None]
        row, place = np.nonzero(energy == cross)
        found.append((x[row], place + offset))
    return np.concatenate([x for x, _ in found]), np.concatenate([d for _, d in found])


class Sequence:
    """Word numbers of several documents, one after another with a separator that occurs once after each."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        places = np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)
        self.words = np.empty(len(ids) + len(lengths), np.int64)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.words[places] = ids
        self.words[self.ends] = -1 - np.arange(len(lengths))
        self.lengths = lengths
        self.document = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.mixed = mix(self.words.astype(np.uint64))
        self.hashes = RunHasher(self.mixed)

    def _reach(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from x and y on (back: before x and y) agree, at most `most`, by bisection over hashes."""
        low, high = np.zeros(len(x), np.int64), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.hashes(x - middle, x) == self.hashes(y - middle, y) if back else self.hashes(x, x + middle) == self.hashes(y, y + middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low

    def grown(self, x: np.ndarray, d: np.ndarray, block: int) -> np.ndarray:
        """Rows (start, end, period) of the stretches around seeds that are long enough, once each."""
        w = self.words
        end, start = self.ends[self.document[x]], self.starts[self.document[x]]
        right, left = w[x + block] == w[np.minimum(x + d + block, len(w) - 1)], (x > start) & (w[x - 1] == w[x + d - 1])
        keep = (x + d + block <= end) & (w[x] == w[np.minimum(x + d, len(w) - 1)]) & (right | left)
        x, d, start, end = x[keep], d[keep], start[keep], end[keep]
        keep = self.hashes(x, x + block) == self.hashes(x + d, x + d + block)
        x, d, start, end = x[keep], d[keep], start[keep], end[keep]
        first = x - self._reach(x, x + d, x - start, back=True)
        last = x + d + block + self._reach(x + block, x + d + block, end - x - d - block, back=False)
        keep = last - first >= np.maximum(MIN_WORDS, MIN_REPEATS * d)
        found = np.unique(np.stack([first, last, d], 1)[keep], axis=0)
        return np.array([self._exact(*row) for row in found], np.int64).reshape(-1, 3)

    def _exact(self, first: int, last: int, d: int) -> tuple[int, int, int]:
        """The stretch as it stands if its words agree; else (two hashes agreed by chance) its longest part that does."""
        same = self.words[first : last - d] == self.words[first + d : last]
        if same.all():
            return first, last, d
        edges = np.flatnonzero(np.diff(np.concatenate(([0], same, [0]))))
        sizes = edges[1::2] - edges[::2]
        k = int(sizes.argmax()) if len(sizes) else 0
        return (first + edges[2 * k], first + edges[2 * k + 1] + d, d) if len(sizes) else (first, first, d)

    def runs(self) -> np.ndarray:
        """Rows (start, end, period) of all runs, by start and period."""
        none = np.zeros((0, 3), np.int64)
        found, scale = [none], 1
        period, until = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        while True:
            shortest = scale // 2 + 1
            able = self.lengths >= max(MIN_WORDS, MIN_REPEATS * shortest)
            if not able.any():
                break
            grid = max(1, scale // 2)
            block = min(grid, MAX_BLOCK)
            x = np.arange(0, len(self.words), grid)
            x = x[able[self.document[x]] & (x + block + shortest <= self.ends[self.document[x]])]
            letters = 1 << (16 - block.bit_length() + 1) // 2  # block * letters^2 < MODULUS
            values = np.zeros(len(self.words) + 3 * block + scale + 2)
            values[: len(self.words)] = self.mixed & np.uint64(letters - 1)
            squares = np.concatenate(([0.0], np.cumsum(values * values)))
            for offset in range(shortest, shortest + grid, block):
                seed, d = zero_mismatches(values, squares, x, block, offset)
                # Inside a known run a multiple of its period only gives that run again.
                known = period[seed]
                new = (known == 0) | (d % np.maximum(known, 1) != 0) | (seed + d + block > until[seed])
                rows = self.grown(seed[new], d[new], block)
                rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(MIN_WORDS, MIN_REPEATS * rows[:, 2])]
                found.append(rows)
                inside = np.repeat(rows[:, 0], rows[:, 1] - rows[:, 0])
                inside += np.arange(len(inside)) - np.repeat(np.cumsum(rows[:, 1] - rows[:, 0]) - (rows[:, 1] - rows[:, 0]), rows[:, 1] - rows[:, 0])
                period[inside], until[inside] = np.repeat(rows[:, 2], rows[:, 1] - rows[:, 0]), np.repeat(rows[:, 1], rows[:, 1] - rows[:, 0])
            scale *= 2
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        # The same stretch has other periods too: multiples of the smallest.
        once = np.ones(len(rows), bool)
        once[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
        rows = rows[once]
        return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def find_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words, rows (start, length, period) of its runs by start and period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy()
    sequence = Sequence(flat.astype(np.int64), lengths)
    rows = sequence.runs()
    document = sequence.document[rows[:, 0]]
    cut = np.searchsorted(document, np.arange(len(texts) + 1))
    rows[:, 1] -= rows[:, 0]
    rows[:, 0] -= sequence.starts[document]
    return [rows[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by a space, without those that a run holds after its first period."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _groups(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for text in texts:
        words = (text or b"").split()  # the six white-space characters of ASCII
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for group in _groups(batch.column(1).cast(pa.binary()).to_pylist()):
            runs = find_runs(group)
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
            rows = np.concatenate(runs)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(_RUN)))
            texts = pa.array([collapsed(w, r) for w, r in zip(group, runs, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(group)), pa.array([len(w) for w in group], pa.int64()), listed, texts], ["doc_id", "n_words", "runs", "collapsed"])
            done += len(group)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs by start and period, collapsed text) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_search, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def longest_run(runs: str = "runs"):
    """The run of greatest length, of several the one with smallest start, then period; null without runs."""
    key = lambda r: F.struct((-r["length"]).alias("by"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))
    return F.array_min(F.transform(runs, key))
