"""N-best segmentation of texts into the pieces of a sentencepiece vocabulary.

A text, with spaces written as ``▁`` and one put in front, is a lattice of the pieces
that spell its parts. A forward Viterbi pass gives the best score of every prefix; a
backward A* search from the end uses these as its heuristic, which is exact, so complete
segmentations leave the queue in the order of their scores.

No piece has a ``▁`` after another character, so words are lattices of their own: what is
found for a word holds wherever it stands. The N best of a text are put together by the
same search over the words whose second choice costs least.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.llm.common import WordMemo, small_batches, texts_of

SPACE = "▁"
N_BEST = 3
MEMO = 250_000  # words a task remembers
CHOICES = 50_000  # words whose n best a task remembers
LONG_WORD = 40


class Vocabulary:
    """Pieces with their scores, and the bytes that stand for any other character."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[str] = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.unknown = model.unk_id()
        self.id: dict[str, tuple[int, float]] = {}
        self.byte: dict[int, int] = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.id[piece] = (i, model.get_score(i))
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.id))
        # A character without a piece costs more than any piece.
        self.penalty = min(s for _, s in self.id.values()) - 10.0

    def edges(self, word: str, end: int) -> list[tuple[int, int, float]]:
        """``start, id, score`` of the pieces that end here; id -1 is a spelled-out character."""
        out = []
        get = self.id.get
        for start in range(max(0, end - self.longest), end):
            found = get(word[start:end])
            if found is not None:
                out.append((start, *found))
        if not out or out[-1][0] != end - 1:
            out.append((end - 1, -1, self.penalty))
        return out

    def spelled(self, char: str) -> list[int]:
        if not self.byte:
            return [self.unknown]
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def n_best(v: Vocabulary, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best segmentations of a lattice with their scores, best first.

    Of equal scores, the one whose last pieces are longer comes first.
    """
    size = len(word)
    ending = [[]] + [v.edges(word, end) for end in range(1, size + 1)]
    best = [0.0] * (size + 1)
    for end in range(1, size + 1):
        best[end] = max(best[start] + score for start, _, score in ending[end])
    # Entries: cost of the whole, starts of its pieces from the end, their ids, score behind.
    queue: list[tuple[float, tuple[int, ...], tuple[int, ...], float]] = [(-best[size], (size,), (), 0.0)]
    out = []
    while queue and len(out) < n:
        cost, starts, path, behind = heapq.heappop(queue)
        at = starts[-1]
        if not at:
            ids: list[int] = []
            for i, start in zip(reversed(path), reversed(starts), strict=False):
                ids += v.spelled(word[start]) if i < 0 else [i]
            out.append((-cost, tuple(ids)))
            continue
        for start, i, score in ending[at]:
            heapq.heappush(queue, (-(best[start] + score + behind), (*starts, start), (*path, i), behind + score))
    return out


class BestPaths:
    """The forward pass for many words at once: best path, and what the second costs more."""

    def __init__(self, v: Vocabulary):
        self.v = v
        pieces = list(v.id.items())
        self.ids = np.array([i for _, (i, _) in pieces], dtype=np.int64)
        self.scores = np.array([s for _, (_, s) in pieces])
        self.keys = np.array([self._hash(p) for p, _ in pieces], dtype=np.uint64)
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("pieces of this vocabulary share a hash")
        # Two tables: what finds its place in the first one taken goes to the second.
        self.first = np.full(1 << 21, -1, dtype=np.int32)
        self.second = np.full(1 << 20, -1, dtype=np.int32)
        for k, (a, b) in enumerate(zip(*self._places(self.keys), strict=True)):
            if self.first[a] < 0:
                self.first[a] = k
            elif self.second[b] < 0:
                self.second[b] = k
            else:
                raise ValueError("no place for a piece of this vocabulary")

    _FACTOR = np.uint64(0x9E3779B97F4A7C15)
    # Not zero, so that a null character in front makes a difference.
    _SEED = np.uint64(0x2545F4914F6CDD1D)

    def _hash(self, piece: str) -> int:
        h = int(self._SEED)
        for c in piece:
            h = ((h ^ ord(c)) * int(self._FACTOR) + 1) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return h

    @staticmethod
    def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(43)).astype(np.int64), (h & np.uint64(0xFFFFF)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with this hash, or -1."""
        a, b = self._places(h)
        k = self.first[a]
        k = np.where((k >= 0) & (self.keys[k] == h), k, self.second[b])
        return np.where((k >= 0) & (self.keys[k] == h), k, -1)

    def of(self, words: list[str]) -> list[tuple[float, float, bytes, bool]]:
        """``score, gap, ids`` of each word; the gap is infinite where there is one path.

        Last comes whether all of its characters stand in pieces of its own letters: such a
        word is spelled by its pieces, the others have to be looked at.
        """
        out: list = [None] * len(words)
        by_size: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            if len(word) <= LONG_WORD:
                by_size.setdefault(len(word), []).append(at)
            else:
                best = n_best(self.v, word, 2)
                gap = best[0][0] - best[1][0] if len(best) > 1 else float("inf")
                out[at] = (best[0][0], gap, np.array(best[0][1], dtype="<u4").tobytes(), False)
        for size, where in by_size.items():
            for at, found in zip(where, self._same_size([words[i] for i in where], size), strict=True):
                out[at] = found
        return out

    def _same_size(self, words: list[str], size: int) -> Iterator[tuple[float, float, bytes, bool]]:
        m = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.ascontiguousarray(codes.reshape(m, size).T).astype(np.uint64)
        top = np.full((size + 1, m), -np.inf)
        runner = np.full((size + 1, m), -np.inf)
        start_of = np.zeros((size + 1, m), dtype=np.int64)
        piece_of = np.full((size + 1, m), -1, dtype=np.int64)
        top[0] = 0.0
        for start in range(size):
            h = np.full(m, self._SEED)
            for end in range(start + 1, min(size, start + self.v.longest) + 1):
                h = (h ^ codes[end - 1]) * self._FACTOR + np.uint64(1)
                h ^= h >> np.uint64(29)
                k = self._find(h)
                score = np.where(k >= 0, self.scores[k], -np.inf if end > start + 1 else self.v.penalty)
                a, b = top[start] + score, runner[start] + score
                better = a > top[end]
                # The best two of both best twos.
                runner[end] = np.where(better, np.maximum(top[end], b), np.maximum(a, runner[end]))
                top[end] = np.where(better, a, top[end])
                start_of[end] = np.where(better, start, start_of[end])
                piece_of[end] = np.where(better, k, piece_of[end])
        # Back along the best paths; characters without a piece are spelled out later.
        at, column, rows = np.full(m, size), np.arange(m), []
        while at.any():
            k = piece_of[at, column]
            rows.append(np.where(at > 0, np.where(k >= 0, self.ids[k], -1 - at), 0))
            live = at > 0
            at = np.where(live, start_of[at, column], 0)
            rows[-1] = np.where(live, rows[-1], np.iinfo(np.int64).min)
        path = np.array(rows).T if rows else np.zeros((m, 0), dtype=np.int64)
        path = path[:, ::-1]
        used = path != np.iinfo(np.int64).min
        odd = ((path < 0) & used).any(axis=1)
        gap = top[size] - runner[size]
        lengths = used.sum(axis=1)
        flat = path[used].astype("<u4").tobytes()
        end = 4 * np.cumsum(lengths)
        for r, (score, g, lo, hi, spell) in enumerate(
            zip(top[size].tolist(), gap.tolist(), (end - 4 * lengths).tolist(), end.tolist(), odd.tolist(), strict=True)
        ):
            if spell:
                ids: list[int] = []
                for i in path[r][used[r]].tolist():
                    ids += self.v.spelled(words[r][-2 - i]) if i < 0 else [i]
                yield score, g, np.array(ids, dtype="<u4").tobytes(), False
            else:
                yield score, g, flat[lo:hi], True


def words_of(text: str) -> list[str]:
    """The lattice's independent parts: what stands between single spaces.

    A part stands for ``▁`` and itself. Where spaces come in runs or at an end, the marks
    are written out after a null character.
    """
    parts = text.split(" ")
    if "" not in parts and "\0" not in text:
        return parts
    out: list[str] = []
    held = "\0"
    for part in parts:
        held += SPACE
        if part:
            out.append(held + part)
            held = "\0"
    return [*out, held] if len(held) > 1 else out


def lattice_of(word: str) -> str:
    """The marks and characters that a part stands for."""
    return word[1:] if word[:1] == "\0" else SPACE + word


class Segmenter:
    """N-best segmentations of texts, word by word."""

    def __init__(self, path: str, n: int = N_BEST):
        self.v, self.n = vocabulary(path), n
        paths = BestPaths(self.v)
        self._memo = WordMemo(lambda words: self._best(paths, [lattice_of(w) for w in words]), MEMO)
        self._choices = WordMemo(lambda words: [self._ranked(lattice_of(w)) for w in words], CHOICES)

    def _best(self, paths: BestPaths, lattices: list[str]) -> list[tuple[float, float, bytes, bool]]:
        return [
            (score, gap, ids, own or self._spelled(np.frombuffer(ids, dtype="<u4").tolist()) == lattice)
            for lattice, (score, gap, ids, own) in zip(lattices, paths.of(lattices), strict=True)
        ]

    def _ranked(self, lattice: str) -> list[tuple[float, bytes, bool]]:
        return [
            (s, np.array(ids, dtype="<u4").tobytes(), self._spelled(list(ids)) == lattice)
            for s, ids in n_best(self.v, lattice, self.n)
        ]

    def segment_all(self, texts: list[str]) -> list[list[tuple[float, bytes, bool]]]:
        """The n best segmentations of each text: scores, little-endian 32-bit ids, and
        whether these spell the text again.

        An empty text has one, without pieces. A word's pieces are spelled once for the
        word: every word begins with a mark, so none shares bytes of a character with the
        next. A text with marks of its own is never spelled again.
        """
        split = [words_of(t) if t else [] for t in texts]
        memo = self._memo.of(set().union(*split))
        return [
            [(s, ids, not bad and SPACE not in text) for s, ids, bad in self._put_together(words, memo)]
            for text, words in zip(texts, split, strict=True)
        ]

    def _put_together(self, words: list[str], memo: dict) -> list[tuple[float, bytes, int]]:
        """Scores, ids, and the number of words that are not spelled again."""
        if not words:
            return [(0.0, b"", 0)]
        scores, gaps, raw, fine = zip(*map(memo.__getitem__, words), strict=True)
        lost = len(words) - sum(fine)
        top = sum(scores)
        # Of the n best, none changes a word whose second choice is not among the n - 1 cheapest.
        gap = np.array(gaps)
        few = min(self.n - 1, len(words))
        where = np.argsort(gap, kind="stable")[:few] if len(words) <= 8 * self.n else (
            cheap := np.flatnonzero(gap <= np.partition(gap, few - 1)[few - 1])
        )[np.argsort(gap[cheap], kind="stable")[:few]]
        where = sorted(int(i) for i in where if gap[i] < np.inf) if few else []
        ranked = self._choices.of({words[i] for i in where})
        # Choices for these words in order; best first, as none is cheaper than the first.
        queue, out = [(0.0, ())], []
        while queue and len(out) < self.n:
            loss, choice = heapq.heappop(queue)
            if len(choice) < len(where):
                options = ranked[words[where[len(choice)]]]
                for c, (score, _, _) in enumerate(options):
                    heapq.heappush(queue, (loss + options[0][0] - score, (*choice, c)))
                continue
            parts, bad = raw, lost
            if any(choice):
                parts = list(raw)
                for i, c in zip(where, choice, strict=True):
                    _, parts[i], again = ranked[words[i]][c]
                    bad += fine[i] - again
            out.append((top - loss, b"".join(parts), bad))
        return out

    def segment(self, text: str) -> list[tuple[float, list[int]]]:
        return [(s, np.frombuffer(ids, dtype="<u4").tolist()) for s, ids, _ in self.segment_all([text])[0]]

    def decode(self, ids: list[int]) -> str:
        """The text that these pieces spell."""
        # The mark in front was put there; other marks are spaces.
        return self._spelled(ids).replace(SPACE, " ")[1:]

    def _spelled(self, ids: list[int]) -> str:
        """The lattice that these pieces spell, with its marks."""
        if self.v.byte_of.keys().isdisjoint(ids):
            return "".join(map(self.v.pieces.__getitem__, ids))
        out, raw = [], bytearray()
        for i in ids:
            if i in self.v.byte_of:
                raw.append(self.v.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.v.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


def text_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of so many bytes of ``text``, or of one longer text; words new to a slice are worked out together."""
    for batch in small_batches(batches, rows):
        upto = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(upto, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start, before = stop, upto[stop - 1]


def encode(
    docs: DataFrame, model: str, n: int = N_BEST, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per document and segmentation: ``doc_id, rank`` (from 0), ``score, n_pieces,
    ids_crc32`` (little-endian 32-bit ids) and ``lossless`` (decoding gives the text back;
    texts that contain ``▁`` themselves lose it). ``ids`` are kept on demand.

    Null and empty texts have one segmentation, without pieces. Rows are independent:
    repeated rows and null ids give rows of their own, an empty table none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(model, n)
        for batch in text_batches(batches):
            rows: list[tuple] = []
            texts = texts_of(batch, "text")
            found = segmenter.segment_all(texts)
            for doc_id, best in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                for rank, (score, raw, same) in enumerate(best):
                    ids = np.frombuffer(raw, dtype="<u4") if with_ids else None
                    rows.append((doc_id, rank, score, len(raw) // 4, zlib.crc32(raw), same, ids))
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
            names = ["doc_id", "rank", "score", "n_pieces", "ids_crc32", "lossless", "ids"]
            columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    slim = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = slim.mapInArrow(
        run,
        "doc_id bigint, rank int, score double, n_pieces bigint, ids_crc32 bigint, lossless boolean, ids array<int>",
    )
    return out if with_ids else out.drop("ids")


def decode(pieces: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``pieces`` with the ``text`` that its ids spell; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(model)
        for batch in small_batches(batches):
            texts = [None if i is None else segmenter.decode(i) for i in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"]
            )

    return pieces.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, decoded string")
