"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, schemes, digits, plus signs and words that
announce an identifier. From each anchor a small parser expands to the left and right
and validates what it found, so a text is never searched by more than one pass.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.llm.common import small_batches, texts_of

# In the order of spans with one start. The last two are the method's own.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ADDRESS = re.compile(r"[A-Za-z0-9._~:/?#@!$&'*+,;=%-]+")
# Parts of a web address that belong to a person or an account.
_PERSONAL = re.compile(
    r"^[^/?#]*@|/[@~][\w.-]+|[?&](?:user|email|token|key|password|session)=[^&#]+", re.I
)
_KEY_ID = re.compile(r"[0-9A-Z]{16}(?![0-9A-Za-z])")
_SECRET = re.compile(r"[\x20:=]{1,3}([^\s,;\"']{8,})")
_IBAN = re.compile(r"[\x20:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:\x20(?:no\.?|number|nr\.?))?[\x20:#=]{1,3}([A-Z]{0,3}[0-9](?:[\x20-]?[0-9]){5,19})")
_CUES = {
    "AKIA": "key_id", "password": "secret", "passwd": "secret",
    "iban": "iban", "account": "account", "acct": "account", "konto": "account",
    "cuenta": "account", "compte": "account",
}


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for digit in _DIGITS:
        automaton.add_word(digit, ("digit", 1))
    automaton.add_word("@", ("at", 1))
    automaton.add_word("+", ("plus", 1))
    automaton.add_word("://", ("scheme", 3))
    for cue, kind in _CUES.items():
        for form in {cue} if cue == "AKIA" else {cue, cue.upper(), cue.title()}:
            automaton.add_word(form, (kind, len(form)))
    automaton.make_automaton()
    return automaton


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _valid_ip(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in match.split("."))


def _valid_card(match: str) -> bool:
    digits = match.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and _luhn(digits)


def _valid_phone(match: str) -> bool:
    return 10 <= sum(c in _DIGITS for c in match) <= 15


def _iban_end(text: str, start: int, end: int) -> int | None:
    """End of the longest prefix that passes the check digits."""
    for stop in range(end, start + 14, -1):
        raw = text[start:stop].replace(" ", "")
        if text[stop - 1] != " " and 15 <= len(raw) <= 34:
            turned = raw[4:] + raw[:4]
            if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1:
                return stop
    return None


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of all personal data, by start and then by kind.

    Base kinds are those of the leftmost matches of their patterns that do not overlap;
    a match that fails its validation is used up all the same.
    """
    done = dict.fromkeys(KINDS, 0)  # end of the last match of a kind
    spans: list[tuple[int, int, str]] = []

    def take(kind: str, start: int, end: int, valid: bool = True) -> None:
        done[kind] = end
        if valid:
            spans.append((start, end, kind))

    for last, (anchor, width) in _anchors().iter(text):
        at = last - width + 1
        if anchor == "digit":
            if at and text[at - 1] in _DIGITS:
                continue
            if at >= done["ip"] and (m := _IP.match(text, at)):
                take("ip", at, m.end(), _valid_ip(m[0]))
            if at >= done["card"] and (m := _CARD.match(text, at)):
                take("card", at, m.end(), _valid_card(m[0]))
        elif anchor == "at":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                take("email", start, m.end())
        elif anchor == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                take("phone", at, m.end(), _valid_phone(m[0]))
        elif anchor == "scheme":
            start = at
            while start > done["url"] and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            m = _ADDRESS.match(text, last + 1)
            if start < at and m and _PERSONAL.search(m[0].rstrip(".,;:!?'")):
                take("url", start, last + 1 + len(m[0].rstrip(".,;:!?'")))
        elif at >= done["account"]:
            if anchor == "key_id" and (m := _KEY_ID.match(text, last + 1)):
                take("account", at, m.end())
            elif anchor == "secret" and (m := _SECRET.match(text, last + 1)):
                take("account", m.start(1), m.end(1))
            elif anchor == "iban" and (m := _IBAN.match(text, last + 1)):
                if end := _iban_end(text, m.start(1), m.end(1)):
                    take("account", m.start(1), end)
            elif anchor == "account" and (m := _ACCOUNT.match(text, last + 1)):
                take("account", m.start(1), m.end(1))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[0], rank[s[2]], s[1]))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Spans replaced by their kind in brackets; overlapping ones become one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, spans_of = [], []
        for text in texts_of(batch, "text"):
            spans = find_spans(text)
            for kind in KINDS:
                counts[kind].append(sum(s[2] == kind for s in spans))
            base = _joined([s for s in spans if s[2] in BASE])
            digests.append(hashlib.sha256(base.encode()).hexdigest())
            spans_of.append(_joined(spans))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS),
                pa.array(digests, pa.string()), pa.array(spans_of, pa.string()),
            ],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, a digest of the base spans and all spans of every text.

    Null texts count as empty. Rows are independent: null ids and repeated rows give a
    row each, an empty table none. Offsets are code points, ends are exclusive.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(
        _scanned,
        "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string",
    )


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in the text; a null text stays null.

    ``length_col``, if ``docs`` has it, is set to the new number of characters.
    """
    schema, columns = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            where = batch.schema.names.index(text_col)
            new = [
                None if t is None else redact(t, find_spans(t)) for t in batch.column(where).to_pylist()
            ]
            yield batch.set_column(where, batch.schema.field(where), pa.array(new, batch.schema.types[where]))

    out = docs.mapInArrow(run, schema)
    if length_col in columns:
        kind = schema[length_col].dataType
        out = out.withColumn(
            length_col, F.when(F.col(f"`{text_col}`").isNull(), F.col(f"`{length_col}`")).otherwise(F.length(f"`{text_col}`")).cast(kind)
        )
    return out
