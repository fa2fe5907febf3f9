"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Kinds: email, ip, card (Luhn), phone, and those that the method adds, iban (mod-97) and routing (bank routing numbers, weights
3, 7, 1), which counts only where a context word raises its score to LEAST_SCORE. Positions are code
points, end exclusive. Every scanner is linear in the length of the text: runs are taken whole
(possessive), and an address is grown outwards from its at sign.

Defined results: a null or empty text has no spans; ties in the start are ordered as the kinds are
listed; repeated rows give equal results; an empty table gives an empty table; columns beside the
id and the text are ignored by `find`, and passed through by `mask`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._held import tidy
from ._session import small_batches

KINDS = ("email", "ip", "card", "phone", "iban", "routing")
_ORDER = {k: i for i, k in enumerate(KINDS)}
SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ROUTING = re.compile(r"(?<![A-Za-z0-9.-])[0-9]{9}(?![A-Za-z0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")

#: Words that make a kind likelier when they stand within REACH code points of a span.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "write"),
    "ip": ("ip", "host", "server", "address", "client", "login"),
    "card": ("card", "credit", "visa", "mastercard", "tarjeta", "karte", "carte", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "contact"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte", "transfer"),
    "routing": ("routing", "aba", "rtn", "bank", "transit"),
}
REACH = 40
_NEAR = {k: re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, v)) + r")(?![^\W_])", re.I) for k, v in CONTEXT.items()}
#: Score of a bare pattern, and what a passed checksum and a context word add.
BARE, CHECKED, NEARBY = 0.55, 0.3, 0.15
#: Scores from which spans of a kind count, where a checksum alone says too little: one in ten numbers passes that of a routing number.
LEAST_SCORE = {"routing": 0.95}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def aba(digits: str) -> bool:
    """Weights 3, 7, 1; first two digits as they are given out."""
    first = int(digits[:2])
    return sum(int(c) * w for c, w in zip(digits, (3, 7, 1) * 3, strict=True)) % 10 == 0 and (first <= 12 or 21 <= first <= 32 or 61 <= first <= 72 or first == 80) and digits != "0" * 9


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            yield begin, free
        at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """At each start the longest run of whole words that passes the checksum."""
    at = 0
    while m := _IBAN.search(text, at):
        end = m.end()
        while end > m.start():
            code = text[m.start() : end].replace(" ", "")
            if len(code) < 15:
                end = -1
            elif len(code) <= 34 and mod97(code):
                break
            else:
                end = text.rfind(" ", m.start(), end)
        if end > m.start():
            yield m.start(), end
            at = end
        else:
            at = m.start() + 1


def scan(text: str | None) -> list[tuple[str, int, int, bool]]:
    """Spans (kind, start, end, checksum passed) in order of start and kind."""
    if not text:
        return []
    found = [("email", a, b, False) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_small, m[0].split("."))):
                found.append(("ip", m.start(), m.end(), False))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end(), True))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end(), False))
        found += [("iban", a, b, True) for a, b in _ibans(text)]
        found += [("routing", m.start(), m.end(), True) for m in _ROUTING.finditer(text) if aba(m[0])]
        found = [s for s in found if s[0] not in LEAST_SCORE or score(text, *s) >= LEAST_SCORE[s[0]]]
    if len(found) > 1:
        found.sort(key=lambda s: (s[1], _ORDER[s[0]]))
    return found


def score(text: str, kind: str, start: int, end: int, checked: bool) -> float:
    near = _NEAR[kind].search(text[max(0, start - REACH) : start]) or _NEAR[kind].search(text[end : end + REACH])
    return round(BARE + CHECKED * checked + NEARBY * bool(near), 2)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """Per row: the id and all spans of its whole text. No shuffle."""

    @tidy
    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                rows.append([{"kind": k, "start": s, "end": e, "score": score(t, k, s, e, c)} for k, s, e, c in scan(t)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(_SPAN))], ["id", "spans"])

    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    got = df.select(id_col, text_col).mapInArrow(run, f"id {kind}, spans {SPANS}")
    return got.toDF(id_col, out_col)


def masked(text: str | None) -> str | None:
    """The text with each stretch of overlapping spans replaced by the kind that opens it, such as [EMAIL]."""
    spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of df, the text masked. No shuffle."""
    at = df.columns.index(text_col)

    @tidy
    def run(batches):
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([masked(t) for t in cols[at].to_pylist()], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)
