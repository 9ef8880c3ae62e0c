"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (leftmost, non-overlapping, a failing match is dropped and not retried): email, ip, card
(14 to 19 digits passing Luhn), phone (10 to 15 digits). The method adds iban (mod-97). Each span has a
score: a prior for its kind, raised by a word nearby that names the kind and lowered by one that speaks
against it. Spans are in code points, end exclusive.

Every pattern starts at a place found by a plain search and is matched without backtracking over runs,
so that the time is linear in the text however long its runs are.

Defined cases: a null text is the empty text and has no spans; no rows give no rows; a repeated row has
its own result; other columns are ignored by `pii_spans` and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, read, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]*[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Score of a confirmed span before the words nearby count.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
#: Words within CONTEXT_CHARS before a span that speak for its kind, or against any kind.
CONTEXT_CHARS = 40
FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|address)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|client|from)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|debit|carte|karte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|konto|compte|cuenta)\b", re.I),
}
AGAINST = re.compile(r"\b(?:version|release|build|isbn|example|order|serial)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(done, at + 1))


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0") or "0") <= 3 and int(q) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if m.end() - m.start() >= 4 and 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    for m in _IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            found.append((m.start(), 4, m.end()))
    out = []
    for start, k, end in sorted(found):
        near, kind = text[max(0, start - CONTEXT_CHARS) : start], KINDS[k]
        score = PRIOR[kind] + (0.1 if FOR[kind].search(near) else 0) - (0.2 if AGAINST.search(near) else 0)
        out.append((kind, start, end, round(min(1.0, max(0.0, score)), 2)))
    return out


def _joined(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_iban, base_sha256, spans, scores) per document."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "scores"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, sums, spans, scores = {k: [] for k in KINDS}, [], [], []
        for text in texts_of(batch.column(1)):
            found = find_spans(text)
            for k in KINDS:
                counts[k].append(sum(x[0] == k for x in found))
            sums.append(hashlib.sha256(_joined([x for x in found if x[0] in BASE_KINDS]).encode()).hexdigest())
            spans.append(_joined(found))
            scores.append([x[3] for x in found])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(sums, pa.string()), pa.array(spans, pa.string()), pa.array(scores, pa.list_(pa.float64()))], names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, scores array<double>"
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def redact_text(text: str, least: float = 0.5) -> str:
    """The text with each base span, and each added span of at least that score, replaced by its kind, as <EMAIL>.

    Where spans overlap, the one that starts first is replaced and the rest of the other with it.
    """
    out, at = [], 0
    for kind, a, b, score in find_spans(text):
        if kind not in BASE_KINDS and score < least:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The same rows and columns, personal data in the text replaced; a null text stays null."""
    names = docs.columns
    k = names.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [None if t is None else redact_text(t, least) for t in batch.column(k).to_pylist()]
        cols = [pa.array(texts, pa.string()) if i == k else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(cols, names)

    return arrow_map(docs, run, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(read(spark, sf_dir, "documents"))
