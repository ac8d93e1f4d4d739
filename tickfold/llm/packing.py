"""Best-fit packing of token sequences by exact complements.

Only the number of pieces of each length matters for a plan, at most ``capacity``
numbers. The plan fills the largest remaining length with a single, pair or triple of
lengths that add up to its gap exactly, as often as they are available together; where
nothing is exact, the longest length that fits goes in and the search goes on. A step
uses up a length, so the plan has a bounded number of patterns however many pieces
there are. Pieces then take their places by their rank among those of equal length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickfold.llm.common import WordMemo, small_batches, stored, texts_of

CAPACITY = 2048
END_ID = 0
# Frequent words whose ids a Python worker remembers.
MEMO = 300_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    """The byte-level vocabulary of a tokenizers file, with its special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # The file shows each byte as a printable character: those that print stand for
    # themselves, the others follow from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {
        bytes(byte[c] for c in token): i
        for token, i in spec["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding(
        "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
    )


class Encoder:
    """Texts to little-endian 32-bit ids, as the tokenizers library gives them.

    A single space always begins a new pre-token, so the words of a text can be encoded
    on their own and frequent ones are remembered. Texts with runs of spaces, or with a
    special token spelled out, are encoded whole.
    """

    def __init__(self, path: str):
        self._encoding = _encoding(path)
        self._special = list(self._encoding._special_tokens)
        self._memo = WordMemo(self._words, MEMO)
        # Tokens that begin with a space: the first ones of words.
        self._first = np.zeros(self._encoding.n_vocab, dtype=bool)
        for token in self._encoding.token_byte_values():
            self._first[self._encoding.encode_single_token(token)] = token.startswith(b" ")

    def whole(self, text: str) -> bytes:
        return np.array(
            self._encoding.encode(text, allowed_special="all"), dtype="<u4"
        ).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that follow a space; none of them has a space itself."""
        if not words:
            return []
        # Other white space at the end of a word would join the space after it.
        tail = [w for w in words if w[-1:].isspace() or not w]
        out = {w: self.whole(" " + w) for w in tail}
        plain = [w for w in words if w not in out]
        ids = np.array(self._encoding.encode_ordinary("".join(f" {w}" for w in plain)), dtype="<u4")
        starts = np.flatnonzero(self._first[ids])
        if len(starts) == len(plain):
            raw, cuts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            out |= {w: raw[a:b] for w, a, b in zip(plain, cuts[:-1], cuts[1:], strict=True)}
        else:
            out |= {w: self.whole(" " + w) for w in plain}
        return [out[w] for w in words]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        odd = {i for i, t in enumerate(texts) if "  " in t or any(s in t for s in self._special)}
        split = [[] if i in odd else t.split(" ") for i, t in enumerate(texts)]
        memo = self._memo.of({w for words in split for w in words[1:]})
        return [
            self.whole(text) if i in odd
            else self.whole(words[0]) + b"".join(map(memo.__getitem__, words[1:]))
            for i, (text, words) in enumerate(zip(texts, split, strict=True))
        ]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = Encoder(path), TaskContext.get().partitionId(), {}
        for batch in small_batches(batches):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "place", "ids")}
            encoded = encoder.encode_all(texts_of(batch, "text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                ids += END_ID.to_bytes(4, "little")
                total, start, piece = len(ids) // 4, 0, 0
                # Only the first piece of a long document may be shorter.
                end = total % capacity or capacity if total > capacity else total
                while start < total:
                    part = ids[4 * start : 4 * end]
                    length = end - start
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["place"].append(seen.get(length, 0))
                    out["ids"].append(part if with_ids else None)
                    seen[length] = seen.get(length, 0) + 1
                    start, end, piece = end, end + capacity, piece + 1
            n = len(out["piece"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["doc_id"], pa.int64()),
                    pa.array(out["piece"], pa.int32()),
                    *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")),
                    pa.array(np.full(n, task), pa.int64()),
                    pa.array(out["place"], pa.int64()),
                    pa.array(out["ids"], pa.binary()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place", "ids"],
            )

    return run


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every text, each text ended by id 0.

    ``task`` and ``place`` number the pieces of one length. ``ids`` (little-endian
    32-bit) are kept on demand.
    """
    slim = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    )
    return slim.mapInArrow(
        _pieces(tokenizer, capacity, with_ids),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "task bigint, place bigint, ids binary",
    )


class _Plan:
    """Patterns of lengths, made from the number of pieces of each length."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()
        self.capacity = len(counts) - 1
        self._sums: np.ndarray | None = None

    def _spare(self, length: int, used: list[int]) -> bool:
        return self.left[length] > used.count(length)

    def _pair(self, gap: int, used: list[int]) -> list[int]:
        """Two available lengths with this sum, the most uneven ones."""
        have = self.left[: gap + 1] > 0
        for b in np.flatnonzero(have[1:] & have[gap - 1 :: -1][: gap]) + 1:
            small, large = int(b), gap - int(b)
            if small > large:
                break
            if self._spare(large, used) and self._spare(small, [*used, large]):
                return [large, small]
        return []

    def _triple(self, gap: int, used: list[int]) -> list[int]:
        if self._sums is None:
            have = (self.left > 0).astype(np.float32)
            size = 2 * len(have)
            spectrum = np.fft.rfft(have, size)
            # Number of ordered pairs of lengths with each sum.
            self._sums = np.rint(np.fft.irfft(spectrum * spectrum, size))[: self.capacity + 1] > 0
        fits = (self.left[1:gap] > 0) & self._sums[gap - 1 : 0 : -1]
        for c in np.flatnonzero(fits)[::-1] + 1:
            if self._spare(int(c), used) and (pair := self._pair(gap - int(c), [*used, int(c)])):
                return [int(c), *pair]
        return []

    def _exact(self, gap: int, used: list[int]) -> list[int]:
        if self._spare(gap, used):
            return [gap]
        return self._pair(gap, used) or self._triple(gap, used)

    def patterns(self) -> Iterator[tuple[list[int], int]]:
        """Lengths put together, and how many sequences are made so."""
        while (present := np.flatnonzero(self.left)).size:
            used = [int(present[-1])]
            while gap := self.capacity - sum(used):
                if exact := self._exact(gap, used):
                    used += exact
                    break
                fitting = present[present <= gap][::-1]
                best = next((int(b) for b in fitting if self._spare(int(b), used)), None)
                if best is None:
                    break
                used.append(best)
            lengths, times = np.unique(used, return_counts=True)
            repeats = int((self.left[lengths] // times).min())
            self.left[lengths] -= repeats * times
            if (self.left[lengths] == 0).any():
                self._sums = None
            yield used, repeats


def plan_slots(counts: np.ndarray) -> dict[int, np.ndarray]:
    """For each length, rows ``first rank, first sequence, offset`` of its places.

    ``counts[n]`` is the number of pieces of ``n`` ids, the last index the capacity.
    """
    ranks = np.zeros(len(counts), dtype=np.int64)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, repeats in _Plan(counts).patterns():
        offset = 0
        for n in lengths:
            slots.setdefault(n, []).append((int(ranks[n]), sequence, offset))
            ranks[n] += repeats
            offset += n
        sequence += repeats
    return {n: np.array(rows, dtype=np.int64) for n, rows in slots.items()}


def _placed(slots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                rows, at = np.flatnonzero(length == n), slots[int(n)]
                k = np.searchsorted(at[:, 0], rank[rows], side="right") - 1
                sequence[rows] = at[k, 1] + rank[rows] - at[k, 0]
                offset[rows] = at[k, 2]
            kept = [i for i, f in enumerate(batch.schema.names) if f != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)],
                names=[*(batch.schema.names[i] for i in kept), "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row per piece with its ``sequence_id`` and ``offset`` in that sequence.

    Null and empty texts are one piece with the end id alone. Repeated rows are packed
    each for itself; null ids stay null. An empty table gives no rows.
    """
    pieces = stored(token_pieces(docs, tokenizer, capacity, with_ids, id_col, text_col), "pieces")
    # Rank of a piece among those of its length: its place in its task, after the
    # pieces of the tasks before.
    counts = stored(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        "length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    # At most `capacity` rows.
    total = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        total[row.length] = row.n
    ranked = pieces.join(before, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        *(["ids"] if with_ids else []),
        (F.col("before") + F.col("place")).alias("rank"),
    )
    return ranked.mapInArrow(
        _placed(plan_slots(total)),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
        + ("ids binary, " if with_ids else "")
        + "sequence_id bigint, offset bigint",
    )
