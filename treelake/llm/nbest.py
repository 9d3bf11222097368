"""N-best segmentation over the lattice of a SentencePiece vocabulary.

Forward Viterbi gives the best score of every prefix; these are exact heuristics for a backward A-star search that
returns the N best segmentations.  Where no piece of the vocabulary reaches across a boundary (before a run of
spaces, around a newline), the lattice falls apart into chunks: a text's N best are made from its chunks' N best.
"""

from __future__ import annotations

import re
from array import array
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush, nsmallest
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: How a model file writes a space.  Here a space stands for itself, which keeps plain text one byte a character.
SPACE = "▁"
#: Distinct chunks a worker remembers.
CACHE = 400_000
#: Bytes of ids of remembered chunks from which on they are forgotten.
HELD = 64_000_000
#: Characters of a chunk up to which it is remembered and worked on together with others; characters of one such lot.
SHORT, WIDE = 64, 1 << 15
#: Letters whose steps in the trie are a table.
NEAR = 128
#: Characters of texts split at once.
SPLIT = 2_000_000
#: Bytes of ids that a batch of rows has at most, or one row.
FLUSH = 2_000_000


class Lattice:
    """Pieces and scores of a model file; bytes stand in for characters without a piece."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        usable = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i).replace(SPACE, " "): (i, sp.get_score(i)) for i in usable if sp.id_to_piece(i)}
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.whole = {p: ((i,), x) for p, (i, x) in self.pieces.items()}
        self.longest = max(map(len, self.pieces))
        self.penalty = min(s for _, s in self.pieces.values() if s > -1e8) - 10.0  # user-defined runs of spaces have -1e9
        self.out = [b""] * len(ids)
        for p, (i, _) in self.pieces.items():
            self.out[i] = p.encode()
        for b, i in self.byte.items():
            self.out[i] = bytes([b])
        splits = not any(re.search("[^ ] |.\n|\n.", p, re.DOTALL) for p in self.pieces)
        self.chunks = re.compile(" *[^ \n]+| +|\n").findall if splits else (lambda s: [s])
        #: The pieces as a trie in arrays: a table of the steps by the most frequent letters, and all the others sorted
        #: by state and letter.  ``letter``: number of a character, the last one for those that no piece holds.
        begin = {p[:k] for p in self.pieces for k in range(len(p) + 1)}
        state = {p: k for k, p in enumerate(sorted(begin, key=lambda p: (len(p), p)))}
        often = [c for c, _ in Counter(c for p in state for c in p[-1:]).most_common()]
        self.letter = np.full(max(map(ord, often)) + 2, len(often), np.int32)
        self.letter[[ord(c) for c in often]] = np.arange(len(often))
        self.near = np.full((len(state), min(NEAR, len(often)) + 1), -1, np.int32)
        steps = []
        for p, k in state.items():
            if p:
                c = int(self.letter[ord(p[-1])])
                if c < self.near.shape[1] - 1:
                    self.near[state[p[:-1]], c] = k
                else:
                    steps.append((state[p[:-1]] * len(self.letter) + c, k))
        self.step_key, self.step_state = np.array(sorted(steps) or [(-1, -1)], np.int64).T.copy()
        self.state_piece, self.state_score = np.full(len(state), -1, np.int32), np.full(len(state), -np.inf)
        for p, (i, x) in self.pieces.items():
            self.state_piece[state[p]], self.state_score[state[p]] = i, x
        self.forget()

    def forget(self) -> None:
        """Empties the memory of chunks: ``cache`` numbers them, the others have what was found, by number."""
        self.cache: dict[str, int] = {}
        self.blobs: list[bytes] = []
        self.scores, self.losses = np.empty(1 << 16), np.empty(1 << 16)
        self.held = 0
        self.several: dict[tuple[str, int], list] = {}

    def _keep(self, blobs: list[bytes], scores: np.ndarray, losses: np.ndarray) -> int:
        """Number of the first of these."""
        k = len(self.blobs)
        while k + len(blobs) > len(self.scores):
            self.scores, self.losses = np.resize(self.scores, 2 * len(self.scores)), np.resize(self.losses, 2 * len(self.losses))
        self.scores[k : k + len(blobs)], self.losses[k : k + len(blobs)] = scores, losses
        self.blobs += blobs
        self.held += sum(map(len, blobs))
        return k

    def fallback(self, c: str) -> tuple[tuple[int, ...], float]:
        raw = c.encode("utf-8", "surrogatepass")
        if len(self.byte) < 256:
            return (self.unknown,), self.penalty
        return tuple(self.byte[b] for b in raw), self.penalty * len(raw)

    def ending(self, s: str, j: int) -> list[tuple[int, tuple[int, ...], float]]:
        """(start, ids, score) of the pieces that end at position j, the longest first."""
        get, out = self.whole.get, []
        for i in range(max(0, j - self.longest), j):
            p = get(s[i:j])
            if p is not None:
                out.append((i, p[0], p[1]))
        if not out or out[-1][0] != j - 1:
            out.append((j - 1, *self.fallback(s[j - 1])))
        return out

    def nbest(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a stretch, best first; equal ones in the order in which the search meets them.

        Backward A-star from the end with the forward scores: the estimate of a hypothesis is exact, so one is followed
        along its best edges to the start at once, and every edge passed by is the hypothesis of a whole segmentation
        of known score.  Of those only the n best found so far are kept.  A hypothesis is a chain of back pointers, and
        edges are looked up where the search passes, so that time and memory grow with the length of the stretch.
        """
        best, back = array("d", [0.0]), [None]
        for j in range(1, len(s) + 1):
            top, at = None, None
            for e in self.ending(s, j):
                v = best[e[0]] + e[2]
                if top is None or v > top:
                    top, at = v, e
            best.append(top)
            back.append(at)
        heap: list = [(0.0, 0, None, len(s))]
        met = 0
        bounds = [float("inf")] * n  # losses of the n best known, ascending
        bounds[0] = 0.0
        out: list[tuple[float, tuple[int, ...]]] = []
        while heap and len(out) < n:
            loss, _, chain, j = heappop(heap)
            if loss > bounds[-1]:
                break
            while j:
                e = back[j]
                top = best[j]
                for f in self.ending(s, j):
                    if f[0] != e[0]:
                        more = loss + top - best[f[0]] - f[2]
                        if more <= bounds[-1]:
                            insort(bounds, more)
                            bounds.pop()
                            met += 1
                            heappush(heap, (more, met, (f[1], chain), f[0]))
                chain = (e[1], chain)
                j = e[0]
            ids = []
            while chain is not None:
                ids += chain[0]
                chain = chain[1]
            out.append((best[-1] - loss, tuple(ids)))
        return out

    def chunk(self, s: str) -> tuple[bytes, float, float]:
        """Best ids as bytes, best score, loss of the second best.

        One forward pass keeps the two best edges into every position; the second best segmentation leaves the best
        one at the place of least difference between them.
        """
        n, low = len(s), float("-inf")
        best, second, start, ids = array("d", [0.0]), array("d", [low]), array("l", [0]), [()]
        for j in range(1, n + 1):
            top = other = low
            for i, p, w in self.ending(s, j):
                v = best[i] + w
                if v > top:
                    top, other, at, mine = v, top, i, p
                elif v > other:
                    other = v
            best.append(top)
            second.append(other)
            start.append(at)
            ids.append(mine)
        path, loss, j = [], -low, n
        while j:
            if best[j] - second[j] < loss:
                loss = best[j] - second[j]
            path.append(ids[j])
            j = start[j]
        flat = [x for p in reversed(path) for x in p]
        return array("i", flat).tobytes(), best[n], loss

    def learn(self, texts: list[list[str]]) -> None:
        """Fills the cache for the short chunks of some texts, many at a time."""
        if len(self.blobs) >= CACHE or self.held >= HELD:
            self.forget()
        by: dict[int, list[str]] = {}
        for c in set().union(*texts).difference(self.cache):
            by.setdefault(len(c), []).append(c)
        for n, group in by.items():
            if n <= SHORT:
                for i in range(0, len(group), max(1, WIDE // n)):
                    self._learn(group[i : i + max(1, WIDE // n)], n)

    def _learn(self, group: list[str], n: int) -> None:
        """``chunk`` of chunks of one length, as array operations over all of them; those that need a fallback are
        left to ``chunk``."""
        m = len(group)
        chars = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n)
        flat = self.letter[np.minimum(chars, len(self.letter) - 1)].T.ravel()  # position by position, all chunks of one
        deep = min(n, self.longest)
        score, piece = np.full((deep, n * m), -np.inf), np.full((deep, n * m), -1, np.int32)
        at, state = np.arange(n * m), np.zeros(n * m, np.int32)
        for d in range(deep):
            if d:
                fits = np.searchsorted(at, (n - d) * m)
                at, state = at[:fits], state[:fits]
            state = self._step(state, flat[at + d * m])
            live = np.flatnonzero(state >= 0)
            at, state = at[live], state[live]
            if not len(at):
                break
            score[d, at] = self.state_score[state]
            piece[d, at] = self.state_piece[state]
        score, piece = score.reshape(deep, n, m), piece.reshape(deep, n, m)
        whole = (piece[0] >= 0).all(axis=0)
        best, second = np.zeros((n + 1, m)), np.full((n + 1, m), -np.inf)
        start = np.zeros((n + 1, m), np.int64)
        each = np.arange(m)
        for j in range(1, n + 1):
            first = max(0, j - deep)
            into = np.stack([best[i] + score[j - i - 1, i] for i in range(first, j)])
            at = into.argmax(axis=0)
            best[j] = into[at, each]
            start[j] = first + at
            into[at, each] = -np.inf
            second[j] = into.max(axis=0)
        at, loss = np.full(m, n), np.full(m, np.inf)
        steps = []
        while True:
            live = at > 0
            if not live.any():
                break
            i = start[at, each]
            with np.errstate(invalid="ignore"):
                loss = np.where(live, np.minimum(loss, best[at, each] - second[at, each]), loss)
            steps.append(np.where(live, piece[at - i - 1, i, each], -1))
            at = np.where(live, i, 0)
        ids = np.stack(steps, axis=1)[:, ::-1].astype(np.int32)
        count = (ids >= 0).sum(axis=1)
        raw, wide = ids.tobytes(), 4 * ids.shape[1]
        good = np.flatnonzero(whole)
        ends = (good + 1) * wide
        blobs = [raw[i:j] for i, j in zip((ends - 4 * count[good]).tolist(), ends.tolist())]
        k = self._keep(blobs, best[n][good], loss[good])
        self.cache.update(zip([group[g] for g in good.tolist()], range(k, k + len(good))))

    def numbers(self, chunks: list[str]) -> list[int]:
        """Numbers of chunks in the memory, into which those that aren't there yet are put."""
        out = list(map(self.cache.get, chunks))
        if None in out:
            for at, k in enumerate(out):
                if k is None:
                    c = chunks[at]
                    k = self.cache.get(c)
                    if k is None:
                        raw, score, loss = self.chunk(c)
                        k = self._keep([raw], score, loss)
                        if len(c) <= SHORT:
                            self.cache[c] = k
                    out[at] = k
        return out

    def _step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Next states of the trie, -1 where there is none."""
        out = self.near[state, np.minimum(letter, self.near.shape[1] - 1)]
        far = np.flatnonzero(letter >= self.near.shape[1] - 1)
        if len(far):
            key = state[far].astype(np.int64) * len(self.letter) + letter[far]
            at = np.searchsorted(self.step_key, key).clip(max=len(self.step_key) - 1)
            out[far] = np.where(self.step_key[at] == key, self.step_state[at], -1)
        return out

    def split(self, text: str | None) -> list[str]:
        return self.chunks(" " + text.replace(SPACE, " ")) if text else []

    def encode(self, text: str | None, n: int) -> list[tuple[float, list[tuple[int, tuple[int, ...]]]]]:
        """The n best of a whole text: (score, changes against the best as (chunk, ids)); the first has no changes."""
        chunks = self.split(text)
        return self.merge(chunks, np.array(self.numbers(chunks), np.int64), n)

    def merge(self, chunks: list[str], numbers: np.ndarray, n: int):
        """n best of a text from its chunks.  Only the n - 1 chunks of least loss can differ from the best segmentation
        in the n best, so the search runs on those alone and their lists are merged."""
        base = float(self.scores[numbers].sum())
        losses = self.losses[numbers]
        at = _least(losses, min(n - 1, len(losses)))
        lists = [(0.0, [])]
        for c in sorted(int(x) for x in at if np.isfinite(losses[x])):
            options = self.several.get((chunks[c], n))
            if options is None:
                options = self.nbest(chunks[c], n)
                options = [(options[0][0] - g, ids) for g, ids in options]
                if len(chunks[c]) <= SHORT:
                    self.several[chunks[c], n] = options
            lists = nsmallest(n, [(a + d, ch + ([(c, ids)] if o else [])) for a, ch in lists for o, (d, ids) in enumerate(options)], key=itemgetter(0))
        return [(base - loss, changes) for loss, changes in lists]

    def decode(self, ids) -> str:
        """Text of piece ids: bytes of their pieces, without the space that encoding puts in front."""
        out = self.out
        raw = b"".join([out[i] for i in ids])
        return raw[1:].decode("utf-8", "surrogatepass")


def _least(losses: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least, the earlier of equal ones."""
    if k == 0:
        return np.empty(0, int)
    cut = np.partition(losses, k - 1)[k - 1]
    below = np.flatnonzero(losses < cut)
    return np.concatenate([below, np.flatnonzero(losses == cut)[: k - len(below)]])


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def nbest_encode(docs: DataFrame, *, n: int = 4, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """``doc_id, rank, score, ids``: the n best segmentations of every whole text, best first.

    ``decode`` adds ``text``, made from each rank's ids as ``nbest_decode`` makes it, without a second pass.
    Null and empty texts have one segmentation without pieces and score 0.  A text has fewer rows than n where its
    lattice holds fewer segmentations.  Equal scores are ordered by the chunk's search order, the same at any time;
    repeated rows come back as often as they stand, and columns other than the two named are ignored.  A null id stays.

    Scores are those the model file gives its pieces, added up; text is taken as it is, without Unicode normalisation.
    In a file of merge ranks (BPE) such a sum orders segmentations but is no log-likelihood, and its best one need not
    be the one that merging gives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model)
        rows, size = [], 0
        for texts in _lots(batches):
            split = [lat.split(t) for _, t in texts]
            lat.learn(split)
            for (i, _), chunks in zip(texts, split):
                found = lat.numbers(chunks)
                best = list(map(lat.blobs.__getitem__, found))
                for r, (score, changes) in enumerate(lat.merge(chunks, np.array(found, np.int64), n)):
                    parts = best
                    if changes:
                        parts = best.copy()
                        for c, ids in changes:
                            parts[c] = array("i", ids).tobytes()
                    rows.append((i, r, score, b"".join(parts)))
                    size += len(rows[-1][3])
                    if size > FLUSH:
                        yield _batch(rows, lat.out if decode else None)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, lat.out if decode else None)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, rank int, score double, ids array<int>" + (", text string" if decode else ""))


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str | None]]]:
    """(id, text) of the rows, in lots of SPLIT characters or one row."""
    lot, size = [], 0
    for f in batches:
        for i, t in zip(f.column(0).to_pylist(), f.column(1)):
            lot.append((i, t.as_py()))
            size += len(lot[-1][1] or "")
            if size >= SPLIT:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


def _batch(rows: list[tuple], out: list[bytes] | None) -> pa.RecordBatch:
    """Rows of ``nbest_encode``, with their texts where ``out``, the bytes of the pieces, is given."""
    i, r, score, raw = zip(*rows)
    ends = np.cumsum([0, *map(len, raw)]) // 4
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), np.int32)))
    columns = {"doc_id": pa.array(i, pa.int64()), "rank": pa.array(r, pa.int32()), "score": pa.array(score, pa.float64()), "ids": ids}
    if out is not None:
        columns["text"] = _texts(ids, pa.array(out, pa.binary()))
    return pa.RecordBatch.from_pydict(columns)


def _texts(ids: pa.ListArray, out: pa.Array) -> pa.Array:
    """Text of every list of ids; null of null."""
    sizes = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
    flat = out.take(ids.flatten())
    raw = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat), b"").to_pylist()
    return pa.array([x[1:].decode("utf-8", "replace") if ok else None for x, ok in zip(raw, ids.is_valid().to_pylist())], pa.string())


def nbest_decode(encoded: DataFrame, *, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """All columns of ``encoded`` and the text of its piece ids, without the space that encoding puts in front.

    Null ids give null; an empty list gives an empty text, which stands for a null one too.  Ids that aren't the
    encoding of a text may hold bytes that are no UTF-8; these become U+FFFD.  Ids beyond the vocabulary are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.array(lattice(model).out, pa.binary())
        for f in batches:
            ids = f.column(f.num_columns - 1)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))])
            at = 0
            while at < len(ids):
                # as many rows as stay within FLUSH, one at least
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + FLUSH // 4, side="right")) - 1)
                part = f.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _texts(part.columns[-1], out)], [*f.schema.names[:-1], text_col])
                at = to

    kept = encoded.drop(text_col)
    rows = kept.select("*", F.col(f"`{ids_col}`").cast("array<int>").alias("__ids"))
    return rows.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(text_col, T.StringType())]))
