"""Personal data by anchor expansion (operator 8).

One Aho-Corasick pass over the whole text finds the anchors: at-signs, plus signs, digits, schemes and
identifier cues. From each anchor a deterministic local parser expands to the boundaries of an e-mail
address, network address, card, phone number, web address, bank account or secret and validates it.
What a parser has consumed is not read again by the same kind, so kinds do not overlap themselves and
the work is linear in the text.

Defined results: a null or empty text has no spans; rows that repeat get equal results; null doc_ids
are kept; an empty table gives an empty result; other columns of the input are ignored. Places are in
code points, ends exclusive.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret", "url")
#: Cues of values that follow them.
SECRET_CUES = ("api_key", "apikey", "passwd", "password", "secret", "token")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_RUN = re.compile(r"[0-9]++")
_ADDRESS = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WEB = re.compile(r"[A-Za-z0-9][^\s<>\"'`{}|\\^]*")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_ACCOUNT = re.compile(r"[ :#=]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SECRET = re.compile(r"\s{0,3}[:=]\s{0,3}(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([^\s\"']{6,}))")


@functools.lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for sign in "@+":
        automaton.add_word(sign, sign)
    for digit in "0123456789":
        automaton.add_word(digit, "0")
    automaton.add_word("://", "://")
    for cue in ("iban", *SECRET_CUES):
        for form in {cue, cue.upper(), cue.capitalize()}:
            automaton.add_word(form, "iban" if cue == "iban" else "secret")
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid_account(text: str) -> bool:
    """Mod-97 check of an account number with country and check digits first."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def personal_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span of one text, in order of kind and start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email = ip = card = phone = url = iban = secret = 0
    for end, anchor in anchors().iter(text):
        if anchor == "0":
            if end >= ip:
                if m := _ADDRESS.match(text, end):
                    ip = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        found["ip"].append(m.span())
                else:  # no later start in this run of digits can match either
                    ip = _RUN.match(text, end).end()
            if end >= card:
                if m := _CARD.match(text, end):
                    card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
                else:
                    card = end + 1
        elif anchor == "@":
            start = end
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < end and (m := _DOMAIN.match(text, end + 1)):
                email = m.end()
                found["email"].append((start, email))
        elif anchor == "+":
            if end >= phone and (m := _PHONE.match(text, end)):
                phone = m.end()
                if 9 <= sum(map(str.isdecimal, m[0])) <= 15:
                    found["phone"].append(m.span())
        elif anchor == "://":
            start = end - 2
            while start > url and text[start - 1] in _SCHEME:
                start -= 1
            if start < end - 2 and text[start].isalpha() and (m := _WEB.match(text, end + 1)):
                url = end + 1 + len(m[0].rstrip(".,;:!?)"))
                found["url"].append((start, url))
        elif anchor == "iban":
            if end >= iban and (m := _ACCOUNT.match(text, end + 1)) and valid_account(m[1].replace(" ", "")):
                iban = m.end(1)
                found["iban"].append(m.span(1))
        elif end >= secret and (m := _SECRET.match(text, end + 1)):
            secret = m.end(m.lastindex)
            found["secret"].append(m.span(m.lastindex))
    return [(kind, a, b) for kind in KINDS for a, b in found[kind]]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end) of every document."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in personal_spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        per_batch, "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array([_redacted(t.as_py()) for t in batch.column(at)], pa.string()))

    return docs.mapInArrow(per_batch, docs.schema)


def _redacted(text: str | None) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in sorted((a, -b, kind) for kind, a, b in personal_spans(text)):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = -b
    return "".join([*out, text[at:]])
