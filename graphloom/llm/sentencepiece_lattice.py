"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

The score of a segmentation is the sum of its pieces' scores.  No piece joins a blank to what stands
before it, so the lattice of a text falls apart into chunks (blank + word); a slice of rows is encoded
by its distinct chunks:

* a forward Viterbi over all distinct chunks of one length at a time gives the best score of every
  prefix, a backward pass that of every suffix, and both the gap between a chunk's best and
  second-best segmentation;
* the N best segmentations of a text change only the N - 1 chunks with the smallest gaps.  There a
  backward A* search runs from the end of the lattice with the forward Viterbi scores as heuristic;
  they are exact, so complete segmentations leave the queue in order of score;
* a lazy merge of the chunks' lists yields the N best of the whole text.

A character that is no piece becomes its UTF-8 byte pieces, at a score below that of all pieces.

A merge model stores merge ranks, whose sums are no likelihood.  Its pieces are scored by the law of Zipf
and Mandelbrot instead: the log-probability of rank r is -log(r + 2.7) less the log of the total.  The
library applies such a model's merges in turn, so its segmentations differ from the most likely ones here.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import run_hashes

BLANK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE_CHARS = 1 << 19
#: Segmentations of chunks that a task keeps at most.
MEMO_EDGES = 400_000
ZIPF_OFFSET = 2.7
_B = np.uint64(0xD6E8FEB86659FD93)


def zipf(n: int) -> np.ndarray:
    """Log-probabilities of the ranks 1 to n."""
    share = 1 / (np.arange(1, n + 1) + ZIPF_OFFSET)
    return np.log(share / share.sum())


class Vocabulary:
    """Pieces, scores and lookup tables of a model file; loaded on the driver; travels inside the plan.

    by_rank: score pieces by the rank of their stored score (merge models); else as stored (unigram models)."""

    def __init__(self, model_file: str = DEFAULT_MODEL, by_rank: bool = True):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)])
        byte = np.array([sp.is_byte(i) for i in range(n)])
        scores = np.array([sp.get_score(i) for i in range(n)])
        if by_rank:
            ordinary = np.flatnonzero(~special & ~byte)
            scores[ordinary[np.argsort(-scores[ordinary], kind="stable")]] = zipf(len(ordinary))
        self._fill(pieces, scores, special, byte, sp.unk_id())

    @classmethod
    def of(cls, pieces: dict[str, float]) -> Vocabulary:
        """A vocabulary of given pieces, preceded by <unk> and 256 byte pieces."""
        self = cls.__new__(cls)
        names = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), *pieces]
        kind = np.arange(len(names))
        self._fill(names, np.array([0.0] * 257 + list(pieces.values())), kind == 0, (kind > 0) & (kind < 257), 0)
        return self

    def _fill(self, pieces: list[str], scores: np.ndarray, special: np.ndarray, byte: np.ndarray, unknown: int) -> None:
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i] and not byte[i]}
        self.scores = scores.astype(np.float64)
        self.unknown, self.byte_ids = unknown, np.full(256, unknown, np.int32)
        for i in np.flatnonzero(byte):
            self.byte_ids[int(pieces[i][3:5], 16)] = i
        ordinary = self.scores[list(self.ids.values())]
        self.fallback = float(min(ordinary[ordinary > -1e8], default=0.0)) - 10.0
        self.longest = max(map(len, self.ids), default=1)
        hashes = np.array([self._hash(p) for p in self.ids], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], np.array(list(self.ids.values()), np.int32)[order]
        self.filter = np.zeros(1 << 21, bool)
        self.filter[hashes >> np.uint64(43)] = True
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        # Characters inside pieces of several characters can join their neighbours; all others stand alone.
        self.joins = np.zeros(0x110000, bool)
        self.joins[[ord(c) for p in self.ids if len(p) > 1 for c in p]] = True
        self.blank_leads = all(BLANK not in p.lstrip(BLANK) for p in self.ids)
        surface = [b"" if special[i] else bytes([int(p[3:5], 16)]) if byte[i] else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        surface[unknown] = " ⁇ ".encode()
        self.size = np.array([len(s) for s in surface], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(_B)) & 0xFFFFFFFFFFFFFFFF
        return h

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices of the hashes that are pieces, their ids)."""
        likely = np.flatnonzero(self.filter[h >> np.uint64(43)])
        h = h[likely]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        found = self.hashes[at] == h
        return likely[found], self.hash_ids[at[found]]

    def chunk_ids(self, edges: list[int]) -> list[int]:
        """Piece ids of lattice edges: an edge below 0 stands for the bytes of the character -1 - edge."""
        out: list[int] = []
        for e in edges:
            out += [e] if e >= 0 else [int(self.byte_ids[b]) for b in chr(-1 - e).encode("utf-8", "surrogatepass")]
        return out

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, offsets) of texts whose ids lie end to end, `count` for each."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        data = self.surface[np.repeat(self.start[ids] - (ends - size), size) + np.arange(total)]
        return data, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(count)))]


def viterbi(codes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best segmentations of chunks of one length, codes [n, L]: (scores, gaps, edges [n, L]).

    edges[:, s] is the edge of the best path that starts at s, or the marker of none (-2 ** 31).
    The gap to the second-best path is infinite where there is only one."""
    n, length = codes.shape
    none = np.int64(-(2**31))
    columns = np.ascontiguousarray(codes.T).astype(np.uint64)
    alpha = np.full((length + 1, n), -np.inf)
    alpha[0] = 0
    back, back_edge = np.zeros((n, length + 1), np.int32), np.zeros((n, length + 1), np.int64)
    lattice = []
    for s in range(length):
        h = np.zeros(n, np.uint64)
        for k in range(1, min(v.longest, length - s) + 1):
            h = (h + columns[s + k - 1] + np.uint64(1)) * _B
            rows, edge = v.lookup(h)
            score, edge = v.scores[edge], edge.astype(np.int64)
            if k == 1 and len(rows) < n:
                lost = np.setdiff1d(np.arange(n), rows, assume_unique=True)
                rows, score = np.concatenate((rows, lost)), np.concatenate((score, np.full(len(lost), v.fallback)))
                edge = np.concatenate((edge, -1 - columns[s][lost].astype(np.int64)))
            if not len(rows):
                continue
            lattice.append((s, k, rows, score))
            total = alpha[s][rows] + score
            better = total > alpha[s + k][rows]
            rows, edge = rows[better], edge[better]
            alpha[s + k][rows] = total[better]
            back[rows, s + k] = k
            back_edge[rows, s + k] = edge
    beta = np.full((length + 1, n), -np.inf)
    beta[length] = 0
    for s, k, rows, score in reversed(lattice):
        beta[s][rows] = np.maximum(beta[s][rows], score + beta[s + k][rows])
    edges, used = np.full((n, length), none), np.zeros((n, length), np.int32)
    at, rows = np.full(n, length), np.arange(n)
    while len(rows):
        k, here = back[rows, at[rows]], at[rows]
        edges[rows, here - k] = back_edge[rows, here]
        used[rows, here - k] = k
        at[rows] = here - k
        rows = rows[at[rows] > 0]
    second = np.full(n, -np.inf)
    for s, k, rows, score in lattice:
        other = used[rows, s] != k
        rows, score = rows[other], score[other]
        second[rows] = np.maximum(second[rows], alpha[s][rows] + score + beta[s + k][rows])
    return alpha[length], alpha[length] - second, edges


def nbest_chunk(chunk: str, n: int, v: Vocabulary) -> list[tuple[float, list[int]]]:
    """The n best segmentations (score, edges) of a chunk, best first.

    Scores that agree to nine decimals are ties; among them the path that has come farthest goes on, so a
    chunk with very many equal segmentations takes no longer than another."""
    length = len(chunk)
    into: list[list[tuple[int, int, float]]] = [[] for _ in range(length + 1)]
    alpha = [0.0] + [-np.inf] * length
    for s in range(length):
        for e in range(s + 1, min(length, s + v.longest) + 1):
            piece = v.ids.get(chunk[s:e])
            if piece is None and e > s + 1:
                continue
            edge, score = (piece, float(v.scores[piece])) if piece is not None else (-1 - ord(chunk[s]), v.fallback)
            into[e].append((s, edge, score))
            alpha[e] = max(alpha[e], alpha[s] + score)
    # An entry: (negative score of the best completion, place, number, score of the suffix, (edge, rest)).
    queue: list[tuple] = [(-round(alpha[length], 9), length, 0, 0.0, None)]
    out: list[tuple[float, list[int]]] = []
    pushed = 0
    while queue and len(out) < n:
        _, at, _, suffix, node = heapq.heappop(queue)
        if at == 0:
            path = []
            while node:
                edge, node = node
                path.append(edge)
            out.append((suffix, path))
            continue
        for s, edge, score in into[at]:
            pushed += 1
            heapq.heappush(queue, (-round(alpha[s] + score + suffix, 9), s, pushed, score + suffix, (edge, node)))
    return out


def merge_nbest(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n largest sums of one entry per list (each descending), as (sum, choice)."""
    start = (0,) * len(lists)
    queue, seen = [(-sum(x[0] for x in lists), start)], {start}
    out = []
    while queue and len(out) < n:
        total, choice = heapq.heappop(queue)
        out.append((-total, choice))
        for i, x in enumerate(lists):
            if choice[i] + 1 < len(x):
                following = (*choice[:i], choice[i] + 1, *choice[i + 1 :])
                if following not in seen:
                    seen.add(following)
                    heapq.heappush(queue, (-sum(y[c] for y, c in zip(lists, following)), following))
    return out


def _slices(lengths: np.ndarray, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` characters; a longer text is taken alone."""
    total, first = np.cumsum(lengths), 0
    while first < len(lengths):
        done = total[first] - lengths[first]
        end = max(first + 1, int(np.searchsorted(total, done + limit, "right")))
        yield first, end
        first = end


class Memo:
    """N-best lists of chunks; emptied when they hold MEMO_EDGES edges and characters together."""

    def __init__(self) -> None:
        self.lists: dict[str, list[tuple[float, list[int]]]] = {}
        self.held = 0

    def add(self, text: str, found: list[tuple[float, list[int]]]) -> None:
        if self.held > MEMO_EDGES:
            self.lists, self.held = {}, 0
        self.lists[text] = found
        self.held += len(text) + sum(8 + len(x) for _, x in found)


class Encoded:
    """Segmentation of a list of texts."""

    def __init__(self, texts: list[str], v: Vocabulary):
        self.v, n = v, len(texts)
        marked = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        self.joined = "".join(marked)
        codes = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate(([0], np.cumsum([len(m) for m in marked]))).astype(np.int64)
        solo, blank = ~v.joins[codes], codes == ord(BLANK)
        cut = np.zeros(len(codes), bool)
        cut[offsets[:-1][offsets[:-1] < len(codes)]] = True
        cut |= solo
        cut[1:] |= solo[:-1]
        if v.blank_leads:
            cut[1:] |= blank[1:] & ~blank[:-1]
        self.starts = np.flatnonzero(cut)
        self.ends = np.append(self.starts[1:], len(codes))[: len(self.starts)]
        size = self.ends - self.starts
        self.bounds = np.searchsorted(self.starts, offsets)
        _, first, self.chunk = np.unique(run_hashes(codes, self.starts, self.ends), return_index=True, return_inverse=True)
        self.first = first
        m = len(first)
        self.score, self.gap = np.zeros(m), np.full(m, np.inf)
        kinds, flat, of = size[first], [], []
        for length in np.unique(kinds):
            group = np.flatnonzero(kinds == length)
            # Long chunks come few at a time, so that the lattice stays small.
            step = max(1, (1 << 21) // int(length * min(length, v.longest)))
            for part in (group[i : i + step] for i in range(0, len(group), step)):
                self.score[part], self.gap[part], edges = viterbi(codes[self.starts[first[part]][:, None] + np.arange(length)], v)
                row, place = np.nonzero(edges != -(2**31))
                flat.append(edges[row, place])
                of.append(part[row])
        flat, of = (np.concatenate(flat), np.concatenate(of)) if flat else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        flat, of = self._with_bytes(flat, of)
        order = np.argsort(of, kind="stable")
        self.flat, count = flat[order], np.bincount(of, minlength=m)
        at = np.concatenate(([0], np.cumsum(count)))
        per = count[self.chunk]
        done = np.cumsum(per)
        self.ids = self.flat[np.repeat(at[self.chunk] - (done - per), per) + np.arange(done[-1] if len(done) else 0)].astype(np.int32)
        self.id_bounds = np.concatenate(([0], done))[self.bounds]
        self.chunk_ends = np.concatenate(([0], done))
        total = np.concatenate(([0], np.cumsum(self.score[self.chunk])))
        self.totals = total[self.bounds[1:]] - total[self.bounds[:-1]]
        self.n = n

    def _with_bytes(self, flat: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lost = np.flatnonzero(flat < 0)
        if not len(lost):
            return flat, of
        parts = [self.v.chunk_ids([int(e)]) for e in flat[lost]]
        reps = np.ones(len(flat), np.int64)
        reps[lost] = [len(p) for p in parts]
        out, ends = np.repeat(flat, reps), np.cumsum(reps)
        for i, p in zip(lost, parts):
            out[ends[i] - reps[i] : ends[i]] = p
        return out, np.repeat(of, reps)

    def nbest(self, row: int, n: int, memo: Memo) -> list[tuple[float, list[tuple[int, list[int]]]]]:
        """Up to n best segmentations of a row: (score, [(chunk place, its edges)] where they differ from the best)."""
        a, b = self.bounds[row], self.bounds[row + 1]
        if a == b or n == 1:
            return [(float(self.totals[row]), [])]
        gaps = self.gap[self.chunk[a:b]]
        near = np.argpartition(gaps, n - 2)[: n - 1] if len(gaps) > n - 1 else np.arange(len(gaps))
        near = np.sort(near[np.isfinite(gaps[near])])
        options = []
        for place in near:
            text = self.joined[self.starts[a + place] : self.ends[a + place]]
            if text not in memo.lists:
                # The Viterbi segmentation comes first, whatever others share its score.
                own = self.ids[self.chunk_ends[a + place] : self.chunk_ends[a + place + 1]].tolist()
                found = nbest_chunk(text, n, self.v)
                memo.add(text, [(found[0][0], []), *[x for x in found if self.v.chunk_ids(x[1]) != own][: n - 1]])
            options.append(memo.lists[text])
        out = []
        for _, choice in merge_nbest([[s for s, _ in o] for o in options], n):
            loss = sum(o[0][0] - o[c][0] for o, c in zip(options, choice))
            out.append((float(self.totals[row] - loss), [(int(a + p), o[c][1]) for p, o, c in zip(near, options, choice) if c]))
        return out

    def ids_of(self, row: int, changes: list[tuple[int, list[int]]]) -> np.ndarray:
        out, at = [], int(self.id_bounds[row])
        for place, edges in changes:
            out += [self.ids[at : self.chunk_ends[place]], np.array(self.v.chunk_ids(edges), np.int32)]
            at = int(self.chunk_ends[place + 1])
        return np.concatenate([*out, self.ids[at : self.id_bounds[row + 1]]])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """One list per array."""
    bounds = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(parts or [np.zeros(0, np.int32)])))


def encode(docs: DataFrame, vocabulary: Vocabulary, n_best: int = 4, alternatives: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids, score, nbest_scores, round_trip [, nbest_ids].

    ids is the best segmentation of the whole text, nbest_scores the scores of the n_best best ones
    (fewer where fewer exist), nbest_ids their ids when `alternatives` is set.  round_trip tells whether
    decoding ids gives the text back; only texts that hold U+2581 itself fail it.  Null and empty texts
    have no ids, score 0 and one (empty) segmentation.  Repeated rows are encoded alike; other columns
    are ignored.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>, score double, nbest_scores array<double>, round_trip boolean" + ", nbest_ids array<array<int>>" * alternatives

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, memo = vocabulary, Memo()
        for b in batches:
            column = b.column("text")
            for first, end in _slices(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)):
                part = [t or "" for t in column.slice(first, end - first).to_pylist()]
                e = Encoded(part, v)
                best = [e.nbest(i, n_best, memo) for i in range(len(part))]
                data, at = v.decode(e.ids, np.diff(e.id_bounds))
                raw = data.tobytes()
                same = [raw[at[i] + 1 : at[i + 1]] == t.encode("utf-8", "surrogatepass") for i, t in enumerate(part)]
                ids = pa.ListArray.from_arrays(pa.array(e.id_bounds, pa.int32()), pa.array(e.ids))
                columns = [b.column("doc_id").slice(first, end - first), ids, pa.array(e.totals), pa.array([[s for s, _ in x] for x in best], pa.list_(pa.float64())), pa.array(same)]
                names = ["doc_id", "ids", "score", "nbest_scores", "round_trip"]
                if alternatives:
                    ranked = _lists([e.ids_of(i, c) for i, x in enumerate(best) for _, c in x])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, best)]), pa.int32()), ranked))
                    names.append("nbest_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return d.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null ids give an empty text, broken UTF-8 is replaced."""
    d = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            data, at = vocabulary.decode(lists.flatten().to_numpy(zero_copy_only=False), count)
            raw = data.tobytes()
            texts = [raw[at[i] + (raw[at[i] : at[i] + 1] == b" ") : at[i + 1]].decode("utf-8", "replace") for i in range(len(count))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string")
