"""Personal data: patterns propose spans, validators confirm them, context adjusts the score.

Proposals come from one pattern a kind, leftmost and without overlaps within the kind. A validator
confirms or drops each: the parts of an address, the Luhn sum of a card, the mod-97 rest of an
account number, the area and group rules of a national number, the number of digits of a phone.
What is left starts from its kind's own score; words near it in the text raise it or lower it. The
four base kinds (e-mail, address, card, phone) are reported whatever the context says, with their score; the
other kinds are weaker patterns and are added only from a threshold on, which some reach by their
validator alone and others only beside a word that names them.

Every rule looks at a span and the ``WINDOW`` code points before and after it, so a text costs time in
proportion to its length, and rows need nothing of each other: there is no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import at, require
from tessitura.llm.tokenization import pieces

#: Code points before and after a span that count as its context.
WINDOW = 48
THRESHOLD = 0.6
BASE = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Whether the sum of the digits, every second one from the right doubled, is a multiple of ten."""
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    total = sum(map(int, digits[-1::-2])) + sum(twice[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an international account number, its first four characters moved to the end and its
    letters read as 10 to 35, leaves 1 when divided by 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _is_ip(text: str) -> bool:
    # by length first: a part may have any number of digits
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in text.split("."))


def _is_card(text: str) -> bool:
    digits = digits_of(text) if len(text) <= 37 else ""
    return 14 <= len(digits) <= 19 and luhn(digits)


def _is_phone(text: str) -> bool:
    return 10 <= len(digits_of(text)) <= 15


def _is_account(text: str) -> bool:
    bare = text.replace(" ", "").upper()
    return 15 <= len(bare) <= 34 and mod97(bare)


def _is_national(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _is_short_card(text: str) -> bool:
    digits = digits_of(text) if len(text) <= 25 else ""
    return len(digits) == 13 and luhn(digits)


def _is_local_phone(text: str) -> bool:
    return 7 <= len(digits_of(text)) <= 15


def _is_secret(text: str) -> bool:
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text)


def emails(text: str) -> Iterator[Span]:
    """Spans of the e-mail pattern, in one pass over its at signs: what can stand before one is the
    longest run of its characters since the last span or sign."""
    floor = 0
    where = text.find("@")
    while where >= 0:
        run = text[floor:where]
        start = floor + len(run.rstrip(_LOCAL))
        floor = where + 1
        found = _DOMAIN.match(text, floor) if start < where else None
        if found:
            floor = found.end()
            yield start, floor
        where = text.find("@", floor)


def _spans(pattern: str) -> Callable[[str], Iterator[Span]]:
    compiled = re.compile(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


@dataclass(frozen=True)
class Kind:
    """One kind of personal data: ``needs`` are strings one of which a text must hold for a proposal
    (none: a digit), ``near`` and ``far`` are words that raise or lower the score."""

    name: str
    find: Callable[[str], Iterator[Span]]
    valid: Callable[[str], bool]
    score: float
    near: str
    far: str = ""
    needs: tuple[str, ...] = ()


# Patterns and words are fixed values. A pattern that begins with a run of one class starts where the
# run does, so that a long run costs one try; what it finds is the same.
KINDS = (
    Kind("email", emails, lambda t: True, 0.9, r"e-?mail|contact|write", r"example", ("@",)),
    Kind("ip", _spans(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}"), _is_ip, 0.6, r"ip|address|host|server|login|client", r"version|release|section|v"),
    Kind("card", _spans(r"[0-9](?:[\x20-]?[0-9])+"), _is_card, 0.8, r"card|visa|mastercard|credit|debit|payment|karte|carte|tarjeta", r"isbn|order|tracking"),
    Kind("phone", _spans(r"\+[0-9][\x20().0-9-]+[0-9]"), _is_phone, 0.7, r"phone|tel|call|mobile|fax|whatsapp|telefon|teléfono|téléphone", r"", ("+",)),
    Kind("account", _spans(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _is_account, 0.9, r"iban|account|bank|konto|compte|cuenta"),
    Kind("national", _spans(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"), _is_national, 0.4, r"ssn|social|security|national|tax|taxpayer", r"part|model|order"),
    Kind("short_card", _spans(r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12}(?![\x20-]?[0-9])"), _is_short_card, 0.4, r"card|visa|credit|debit|payment|karte|carte|tarjeta", r"isbn|ean|barcode"),
    Kind("local_phone", _spans(r"(?<![0-9A-Za-z+(.-])(?<![0-9+][\x20(])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20.-])[0-9]{3,4}[\x20.-]?[0-9]{3,5}(?![0-9A-Za-z]|[.-][0-9])"), _is_local_phone, 0.3, r"phone|tel|call|mobile|fax|whatsapp|telefon|teléfono|téléphone", r"order|isbn|version"),
    Kind("secret", _spans(r"(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{20,128}(?![0-9A-Za-z_-])"), _is_secret, 0.3, r"token|secret|password|passwd|api_?key|access_?key|credential", r"sha1|sha256|md5|commit|checksum"),
)
_WORDS = {k.name: (re.compile(rf"(?<![^\W\d_])(?:{k.near})(?![^\W\d_])", re.I), re.compile(rf"(?<![^\W\d_])(?:{k.far})(?![^\W\d_])", re.I) if k.far else None) for k in KINDS}
RANK = {k.name: n for n, k in enumerate(KINDS)}


def score(kind: Kind, text: str, start: int, end: int) -> float:
    """The kind's own score, 0.35 more beside a word that names it and 0.3 less beside one that
    names something else; from 0 to 1."""
    near, far = _WORDS[kind.name]
    around = text[max(0, start - WINDOW) : start] + "\n" + text[end : end + WINDOW]
    value = kind.score + 0.35 * bool(near.search(around)) - 0.3 * bool(far and far.search(around))
    return round(min(1.0, max(0.0, value)), 2)


def spans_of(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) of a text in order of start, then of kind as in ``KINDS``.

    Base kinds stand whatever they overlap. A span of another kind goes if a base span or an earlier
    kind's span overlaps it.
    """
    digit = _DIGIT.search(text) is not None
    out: list[tuple[str, int, int, float, bool]] = []
    starts: list[int] = []  # of what is taken so far, in order and without overlaps
    ends: list[int] = []
    for kind in KINDS:
        if not (any(n in text for n in kind.needs) if kind.needs else digit):
            continue
        base = kind.name in BASE
        own = []
        for start, end in kind.find(text):
            if not kind.valid(text[start:end]):
                continue
            value = score(kind, text, start, end)
            if not base:
                k = bisect_left(starts, end)  # the last one that begins before the end
                if value < threshold or k and ends[k - 1] > start:
                    continue
            own.append((kind.name, start, end, value, base))
        if own:
            out += own
            starts, ends = _merged([*zip(starts, ends, strict=True), *((s, e) for _, s, e, _, _ in own)])
    return sorted(out, key=lambda x: (x[1], RANK[x[0]]))


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])
SCHEMA = "spans array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>, redacted string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, redact: bool = False) -> DataFrame:
    """Returns the id and ``spans`` (kind, start, end, score, base) of every whole text, a row for
    each row; places are code points, the end exclusive. With ``redact``, also ``redacted``: the text
    with each span, or run of spans that overlap, replaced by its first kind in brackets.

    A null or empty text has no spans and is redacted to an empty one. Null and repeated ids are passed
    on, other columns take no part, and an empty table gives an empty table.
    """
    require(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch.column(1)):
                texts = [t or "" for t in batch.column(1)[part].to_pylist()]
                found = [spans_of(t, threshold) for t in texts]
                made = pa.array([[dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in spans] for spans in found], pa.list_(SPAN))
                bare = pa.array([redacted(t, s) for t, s in zip(texts, found, strict=True)] if redact else [None] * len(texts), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], made, bare], names=["id", "spans", "redacted"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(at(docs, id_col).alias("id"), at(docs, text_col).alias("text")).mapInArrow(run, f"id {kind}, {SCHEMA}")
    return (out if redact else out.drop("redacted")).withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[str, int, int, float, bool]]) -> str:
    out, done = [], 0
    for kind, start, end, _, _ in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
