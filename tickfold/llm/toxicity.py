"""Toxicity from a learned lexicon, found through Levenshtein automata.

The lexicon is learned from labelled documents: words that occur in toxic ones only, and
stems that only toxic ones use in different words close to each other. Its trie is
intersected with the automaton of all words within one edit, state by state as texts ask
for it, so a misspelled term costs one walk over its letters. What a term says depends on
the words around it: next to quotation, and for a stem used alone, it counts with the
precision that such uses had in training.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.llm.common import small_batches, stored, texts_of

SAMPLE = 20_000  # labelled documents learned from, at most
SUPPORT = 5  # different contexts in toxic documents a term needs; copies share theirs
PRECISION = 0.9
STEM = (4, 5, 6, 7, 8)
STEM_SUPPORT = 3  # toxic documents a stem needs
NEAR = 40  # words between two uses of a stem that support each other
FUZZY_LENGTH = 5  # shorter terms must be spelled right
WINDOW = 6  # words on both sides
THRESHOLD = 0.3
MEMO = 300_000  # words a task remembers
CONTEXTS = 1_000_000  # uses a task remembers while it looks for different contexts
STATES = 200_000  # automaton states a task keeps

# Words that introduce what somebody else said (fixed values).
QUOTING = frozenset(
    "said says say quote quoted quotes called calls cited wrote sagte sagt schrieb zitat nannte "
    "dit disait cite citation appelle dijo dice escribió cita llamó".split()
)
_MARKS = "\"'“”„«»‘’‚‹›"
_STRIP = re.compile(r"^\W+|\W+$")


@dataclass
class Lexicon:
    """Terms with their precision by (weak, quoted); misspelled words and lone stems are weak."""

    words: dict[str, float]
    stems: dict[str, float]
    base: float = 0.01
    share: float = 0.0  # of toxic documents among all
    evidence: dict[tuple[str, bool, bool], tuple[int, int]] = field(default_factory=dict)

    def precision(self, term: str, weak: bool, quoted: bool) -> float:
        """Share of toxic documents among those with the term used so, smoothed."""
        prior = self.words.get(term, self.stems.get(term, self.base))
        prior *= (0.7 if weak else 1.0) * (0.25 if quoted else 1.0)
        toxic, docs = self.evidence.get((term, weak, quoted), (0, 0))
        return (toxic + 2 * prior) / (docs + 2)

    def weight(self, term: str, weak: bool, quoted: bool) -> float:
        """How far the precision exceeds what any document has, from 0 to 1."""
        return max(0.0, self.precision(term, weak, quoted) - self.share) / (1 - self.share)


class Automaton:
    """Words within one edit of a term, or with a stem; built as words are read.

    A state is a set of (trie node, edits). Its transitions are kept.
    """

    def __init__(self, lexicon: Lexicon):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.room: list[bool] = [False]  # a term that may be misspelled lies below
        for words, ends in ((lexicon.words, self.term), (lexicon.stems, self.stem)):
            for word in words:
                node, path = 0, [0]
                for c in word:
                    node = self.children[node].setdefault(c, len(self.children))
                    if node == len(self.children):
                        for column, empty in ((self.children, {}), (self.term, None), (self.stem, None), (self.room, False)):
                            column.append(empty)
                    path.append(node)
                ends[node] = word
                if ends is self.term and len(word) >= FUZZY_LENGTH:
                    for n in path:
                        self.room[n] = True
        self._reset()

    def _reset(self) -> None:
        self._sets: list[frozenset] = []
        self._number: dict[frozenset, int] = {}
        self._next: list[dict[str, int]] = []
        self._start = self._state({(0, 0)})

    def _state(self, found: set[tuple[int, int]]) -> int:
        # A letter of the term left out: its children are reached with an edit.
        found |= {(c, 1) for n, e in found if not e for c in self.children[n].values() if self.room[c]}
        key = frozenset(found)
        if key not in self._number:
            self._number[key] = len(self._sets)
            self._sets.append(key)
            self._next.append({})
        return self._number[key]

    def _step(self, state: int, letter: str) -> int:
        found: set[tuple[int, int]] = set()
        for node, edits in self._sets[state]:
            below = self.children[node]
            if letter in below and (not edits or self.room[below[letter]]):
                found.add((below[letter], edits))
            if not edits and self.room[node]:
                found.add((node, 1))  # a letter too many
                found.update((c, 1) for c in below.values() if self.room[c])  # another letter
        to = self._state(found) if found else -1
        self._next[state][letter] = to
        return to

    def match(self, word: str) -> tuple[str, bool] | None:
        """The term that ``word`` is or begins with, and whether it is misspelled."""
        if len(self._sets) > STATES:
            self._reset()
        state, stem, node = self._start, None, 0
        for letter in word:
            if node >= 0:
                node = self.children[node].get(letter, -1)
                if node >= 0 and self.stem[node]:
                    stem = self.stem[node]
            to = self._next[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if state < 0:
                break
        # Terms that begin with a stem count as its uses if spelled right, and by themselves if not.
        if stem:
            return stem, False
        if node >= 0 and self.term[node]:
            return self.term[node], False
        if state >= 0:
            near = [self.term[n] for n, _ in self._sets[state] if self.term[n] and len(self.term[n]) >= FUZZY_LENGTH]
            if near:
                return min(near), True
        return None


def near_uses(uses: Iterable[tuple[int, str, str]]) -> Iterator[tuple[int, int, str]]:
    """``place, place, stem`` of uses ``place, word, stem`` in different words close by."""
    last: dict[str, tuple[int, str]] = {}
    for place, word, stem in uses:
        before = last.get(stem)
        if before and place - before[0] <= NEAR and word != before[1]:
            yield before[0], place, stem
        last[stem] = (place, word)


class Scorer:
    """Finds terms in texts and weighs them by their windows."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton = lexicon, Automaton(lexicon)
        self._clean: set[str] = set()
        self._bad: dict[str, tuple[str, bool]] = {}

    def hits(self, text: str) -> set[tuple[str, bool, bool]]:
        """``term, weak, quoted`` for every use of a term."""
        words = text.lower().split()
        distinct = set(words)
        for word in distinct - self._clean:
            if word not in self._bad:
                found = self.automaton.match(_STRIP.sub("", word))
                if found:
                    self._bad[word] = found
                elif len(self._clean) < MEMO:
                    self._clean.add(word)
        used = distinct & self._bad.keys()
        if not used:
            return set()
        uses = [(i, *self._bad[word]) for i, word in enumerate(words) if word in used]
        # Other stems of the lexicon support a stem as well as its own do.
        stems = ((i, _STRIP.sub("", words[i]), "") for i, term, _ in uses if term in self.lexicon.stems)
        backed = {i for a, b, _ in near_uses(stems) for i in (a, b)}
        out = set()
        for i, term, fuzzy in uses:
            word, weak = words[i], fuzzy or (term in self.lexicon.stems and i not in backed)
            around = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            opened = any(w[0] in _MARKS for w in (*words[max(0, i - WINDOW) : i], word))
            closed = any(w.rstrip(".,;:!?")[-1:] in _MARKS and w.rstrip(".,;:!?") for w in (word, *words[i + 1 : i + 1 + WINDOW]))
            told = any(_STRIP.sub("", w) in QUOTING for w in around)
            out.add((term, weak, (opened and closed) or told))
        return out

    def score(self, text: str) -> float:
        """Probability that some use of a term is abuse; the base rate without one."""
        clean = 1 - self.lexicon.base
        for term, weak, quoted in self.hits(text):
            clean *= 1 - min(0.999, self.lexicon.weight(term, weak, quoted))
        return min(1.0, max(0.0, 1 - clean))


def held_out(id_col: str = "doc_id"):
    """Rows that no label may be learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(4)) == 2, F.lit(False))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        words = [sorted({_STRIP.sub("", w) for w in t.lower().split()} - {""}) for t in texts_of(batch, "text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array(words, pa.list_(pa.string()))], names=["toxic", "words"]
        )


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stems that a document uses in different words close to each other."""
    for batch in small_batches(batches):
        stems = []
        for text in texts_of(batch, "text"):
            said = [(i, _STRIP.sub("", w)) for i, w in enumerate(text.lower().split())]
            uses = ((i, w, w[:n]) for i, w in said for n in STEM if len(w) >= n)
            stems.append(sorted({stem for _, _, stem in near_uses(uses)}))
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array(stems, pa.list_(pa.string()))], names=["toxic", "stems"]
        )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``term, stem, context`` for uses of words and stems; a context is the words beside it.

    A task leaves out contexts it gave before, and those of terms it gave SUPPORT of. What it
    remembers is forgotten when it grows large; then contexts are given again.
    """
    given: dict[tuple[str, bool], set[int]] = {}
    size = 0
    for batch in small_batches(batches, 64):
        rows: list[tuple[str, bool, int]] = []
        for text in texts_of(batch, "text"):
            said = [_STRIP.sub("", w) for w in text.lower().split()]
            for i, word in enumerate(said):
                if not word:
                    continue
                beside = " ".join(said[max(0, i - 1) : i] + ["*"] + said[i + 1 : i + 2])
                context = zlib.crc32(beside.encode("utf-8", "surrogatepass"))
                for key in ((word, False), *((word[:n], True) for n in STEM if len(word) >= n)):
                    known = given.setdefault(key, set())
                    if len(known) < SUPPORT and context not in known:
                        known.add(context)
                        rows.append((*key, context))
                        size += 1
            if size > CONTEXTS:
                given, size = {}, 0
        terms, stems, contexts = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array(stems, pa.bool_()), pa.array(contexts, pa.int64())],
            names=["term", "stem", "context"],
        )


def _strongest(hits: set[tuple[str, bool, bool]]) -> list[tuple[str, bool, bool]]:
    """Uses of the plainest kind in a document; they explain its label, others do not."""
    kind = min(((weak, quoted) for _, weak, quoted in hits), default=None)
    return [hit for hit in hits if hit[1:] == kind]


def _evidence(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in small_batches(batches):
            rows = [
                (*hit, toxic)
                for toxic, text in zip(batch.column("toxic").to_pylist(), texts_of(batch, "text"), strict=True)
                for hit in _strongest(scorer.hits(text))
            ]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("term", "weak", "quoted", "toxic"), r, strict=True)) for r in rows],
                pa.schema([("term", pa.string()), ("weak", pa.bool_()), ("quoted", pa.bool_()), ("toxic", pa.int32())]),
            )

    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """The lexicon of SAMPLE labelled rows at most that are not held out."""
    chosen = (
        labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
        .where("_id is not null and toxic is not null")
        .where(~held_out("_id"))
        .groupBy("_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    )
    text = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"))
    # At most SAMPLE short rows are broadcast.
    train = stored(text.join(F.broadcast(stored(chosen, "chosen")), "_id").select("text", "toxic"), "train")
    words = stored(
        train.mapInArrow(_words, "toxic int, words array<string>")
        .select("toxic", F.explode("words").alias("word"))
        .groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")),
        "words",
    )
    used = words.where(F.length("word") >= 3).select(F.col("word").alias("term"), F.lit(False).alias("stem"), "t", "n")
    near = (
        train.mapInArrow(_stems, "toxic int, stems array<string>")
        .select("toxic", F.explode("stems").alias("term"))
        .groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
        .select("term", F.lit(True).alias("stem"), "t", "n")
    )
    support = F.when(F.col("stem"), STEM_SUPPORT).otherwise(SUPPORT)
    good = used.union(near).where((F.col("t") >= support) & (F.col("t") >= PRECISION * F.col("n")))
    # Words of a text that was copied are many, but always beside the same words.
    varied = (
        train.where("toxic = 1").select("text").distinct()
        .mapInArrow(_contexts, "term string, stem boolean, context bigint")
        .groupBy("term", "stem").agg(F.count_distinct("context").alias("contexts"))
        .where(F.col("contexts") >= SUPPORT).select("term", "stem")
    )
    # All that pass every test: each was met in SUPPORT contexts of a bounded sample.
    found = good.join(varied, ["term", "stem"], "left_semi").collect()
    stems: dict[str, float] = {}
    begun: set[str] = set()  # what stems begin with
    for r in sorted((r for r in found if r.stem), key=lambda r: (-r.t, -len(r.term), r.term)):
        # Of stems that begin with each other the best known stays, the longest of equals.
        kin = {r.term[:n] for n in STEM} & stems.keys()
        if not kin and r.term not in begun:
            stems[r.term] = (r.t + 1) / (r.n + 2)
            begun.update(r.term[:n] for n in STEM if n <= len(r.term))
    terms = {
        r.term: (r.t + 1) / (r.n + 2)
        for r in sorted(found, key=lambda r: r.term)
        if not r.stem and (len(r.term) >= FUZZY_LENGTH or not any(r.term[:n] in stems for n in STEM))
    }
    counted = train.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    share = (counted.t or 0) / max(1, counted.n)
    lexicon = Lexicon(terms, stems, base=min(0.05, share / 10 + 1e-3), share=min(0.5, share))
    # Few rows: a count for each term and kind of use.
    uses = (
        train.mapInArrow(_evidence(lexicon), "term string, weak boolean, quoted boolean, toxic int")
        .groupBy("term", "weak", "quoted").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()
    )
    lexicon.evidence = {(r.term, r.weak, r.quoted): (int(r.t), int(r.n)) for r in uses}
    return lexicon


def score_texts(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null texts count as empty; they and texts without a term have the base score. Null
    ids are not held out. Rows are independent, an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in small_batches(batches):
            scores = [scorer.score(t) for t in texts_of(batch, "text")]
            assert not any(math.isnan(s) for s in scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "score"],
            )

    slim = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text")
    )
    scored = slim.mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
