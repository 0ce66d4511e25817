"""Personal data: proposed by regular expressions, confirmed by checksums, scored with context."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: kind, what the text must hold at all, pattern, score before context, words that speak for it.
RULES: list[tuple[str, str, str, float, str]] = [
    ("email", "@", r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+", 0.9, r"e-?mail|mail|contact|correo|courriel|kontakt"),
    ("iban", "", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 0.8, r"iban|bank|konto|cuenta|compte|account"),
    ("card", "", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]|\.\d)", 0.6, r"card|visa|credit|karte|tarjeta|carte|amex|payment"),
    ("ssn", "-", r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])", 0.55, r"ssn|social|security|sozial"),
    ("ipv4", ".", rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)", 0.6, r"ip|address|host|server|adresse"),
    ("phone", "", r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4})(?![\w-])", 0.5, r"phone|tel|call|mobile|fax|telefon|móvil"),
    ("secret", "", r"(?i)(?<![a-z0-9])(?:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd)[\"']?\s*[=:]\s*[\"']?[^\s\"']{8,}", 0.8, r"token|secret|key|password|credential"),
    ("key", "", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])", 0.9, r"key|token|aws"),
]
#: A span is reported from this score on; a context word within REACH characters adds to it, a negating
#: word within the BEFORE characters on its left takes away.
THRESHOLD, BONUS, MALUS, REACH, BEFORE = 0.5, 0.2, 0.3, 48, 16
_against = re.compile(r"(?i)(?<!\w)(?:isbn|version|sample|dummy|order|part no)(?!\w)")
_digit = re.compile(r"[0-9]")


def luhn(number: str) -> bool:
    digits = [ord(c) - 48 for c in number if "0" <= c <= "9"]
    total = sum(digits[-1::-2]) + sum(d * 2 - 9 * (d > 4) for d in digits[-2::-2])
    return 13 <= len(digits) <= 19 and total % 10 == 0 and len(set(digits)) > 1


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


_CHECK = {"card": luhn, "iban": mod97}
_rules = [(kind, must, re.compile(p), score, re.compile(rf"(?i)(?<!\w)(?:{words})(?!\w)")) for kind, must, p, score, words in RULES]


def spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, confirmed by a checksum); offsets count characters, `end` is exclusive.

    Overlapping spans: the higher score stays, then the longer, then the earlier.
    """
    found = []
    digits = _digit.search(text) is not None
    for kind, must, pattern, base, words in _rules:
        if (must and must not in text) or (not digits and kind not in ("email", "secret")):
            continue
        for m in pattern.finditer(text):
            check = _CHECK.get(kind)
            s, e = m.span()
            if check and not check(m[0]):
                # IBANs in running capitals: the longest proper prefix with a right checksum
                cut = next((c for c in range(e - 1, s + 14, -1) if check(text[s:c])), None) if kind == "iban" else None
                if cut is None:
                    continue
                e = cut
            near = text[max(0, s - REACH) : s] + "\n" + text[e : e + REACH]
            score = base + BONUS * (words.search(near) is not None) - MALUS * (_against.search(text, max(0, s - BEFORE), s) is not None)
            if score >= THRESHOLD:
                found.append((kind, s, e, round(min(score, 1.0), 3), check is not None))
    found.sort(key=lambda x: (-x[3], x[1] - x[2], x[1], x[0]))
    kept: list[tuple[str, int, int, float, bool]] = []
    taken: list[tuple[int, int]] = []
    import bisect

    for f in found:
        i = bisect.bisect_left(taken, (f[2], -1))
        if i and taken[i - 1][1] > f[1]:
            continue
        bisect.insort(taken, (f[1], f[2]))
        kept.append(f)
    return sorted(kept, key=lambda x: x[1:3])


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per confirmed span: doc_id, kind, start, end, score, validated. A pass without a shuffle.

    NULL or empty texts have no spans. A row that occurs twice reports its spans twice; a NULL doc_id is
    carried on; other columns are ignored. Whole texts are searched, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    out += [(i, *s) for s in spans(t)]
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "kind", "start", "end", "score", "validated"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, kind string, start long, end long, score double, validated boolean")
