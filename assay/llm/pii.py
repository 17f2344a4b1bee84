"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

``detect`` keeps one row per input row. A null or empty text has no spans; repeated
rows repeat their result; other input columns are ignored. The scanners are linear in the text:
digit runs are matched possessively and mail addresses are grown from their ``@``.

A span's score is the prior of its kind, raised by words that name the kind and lowered by words that name
something else, in English, German, French or Spanish, up to ``BEFORE`` characters before and ``AFTER`` after it.
Spans of the base kinds are always reported with their score. Those of the other kinds are reported from
``KEEP`` on, and not where they overlap a base span: an IBAN is dropped among words that say it is made up, a number
written as a US social security or local phone number counts only beside words that say so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "tel")
SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "tel": 0.35}
#: Beginnings of words, in lower case, that raise a score, and those that lower it.
_CALL = "phone|call|tel|mobile|cell|fax|anruf|rufnummer|handy|t[eé]l[eé]|appel|portable|m[oó]vil|llam"
RAISE = {
    "email": "e-?mail|mail|contact|write|kontakt|schreib|courriel|[eé]cri|correo|escrib",
    "ip": "ip\\b|address|host|server|adress|rechner|serveur|servidor|direcci",
    "card": "card|visa|credit|payment|kart|kredit|zahlung|carte|paiement|tarjeta|pago",
    "phone": _CALL,
    "iban": "iban|bank|account|transfer|konto|[uü]berweis|compte|virement|cuenta|banco",
    "ssn": "ssn|social|security|taxpayer",
    "tel": _CALL,
}
_FAKE = "dummy|placeholder|fake|fictiti|fiktiv|muster|fictif|ficticio"
LOWER = {
    "email": _FAKE,
    "ip": f"{_FAKE}|version|release|build|firmware",
    "card": f"{_FAKE}|isbn|serial|tracking|invoice|rechnung|facture|factura",
    "phone": _FAKE,
    "iban": _FAKE,
    "ssn": f"{_FAKE}|order|invoice|serial|part",
    "tel": f"{_FAKE}|order|invoice|serial|isbn|part",
}
BEFORE, AFTER = 40, 20
BONUS, MALUS, KEEP = 0.2, 0.35, 0.5
#: ``mask`` leaves a span of a lower score.
LEAST_MASKED = 0.3
_WORDS = {k: tuple(re.compile(rf"\b(?:{w[k]})", re.A) for w in (RAISE, LOWER)) for k in KINDS}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: Characters of an IBAN by country, as in the registry or in use.
IBAN_LENGTH = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
        28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
LEAST_IBAN = 15
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+(])(?:\(0[0-9]{1,4}\)|0[0-9]{1,4})[ /.-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_NON_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, (done := m.end())
        at += 1


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NON_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


def _iban_spans(text: str, at: int, stop: int, listed: bool) -> Iterator[tuple[int, int]]:
    while m := _IBAN.search(text, at, stop):
        at = m.start() + 1
        own = IBAN_LENGTH.get(m[0][:2])
        if listed != bool(own):
            continue
        ends = [i + 1 for i, c in enumerate(m[0], m.start()) if c != " "]
        for n in (own,) if own else range(len(ends), LEAST_IBAN - 1, -1):
            if n <= len(ends) and not _ALNUM.match(text, end := ends[n - 1]) and mod97(text[m.start() : end]):
                yield m.start(), (at := end)
                break


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """What follows an IBAN may look like more of it: its country tells where it ends, and for other codes, between those, the longest run of words that passes."""
    done = 0
    for start, end in _iban_spans(text, 0, len(text), True):
        yield from _iban_spans(text, done, start, False)
        yield start, (done := end)
    yield from _iban_spans(text, done, len(text), False)


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _SSN.finditer(text))


def _tels(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _TEL.finditer(text))


_FINDERS = dict(zip(KINDS, (_emails, _ips, _cards, _phones, _ibans, _ssns, _tels), strict=True))


def score_of(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - BEFORE) : start].lower(), text[end : end + AFTER].lower()
    raised, lowered = (any(words.search(n) for n in near) for words in _WORDS[kind])
    return round(min(1.0, max(0.0, PRIOR[kind] + BONUS * raised - MALUS * lowered)), 6)


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by kind as listed, then by start."""
    out: list[tuple[str, int, int, float]] = []
    taken: list[tuple[int, int]] | None = None
    for kind, find in _FINDERS.items() if text else ():
        for start, end in find(text):
            score = score_of(kind, text, start, end)
            if kind not in BASE:
                if score < KEEP:
                    continue
                if taken is None:
                    taken = [(a, b) for k, a, b, _ in out if k in BASE]
                if any(a < end and start < b for a, b in taken):
                    continue
            out.append((kind, start, end, score))
    return out


def masked(text: str | None, least: float) -> str | None:
    """``text`` with each span of enough score replaced by its kind; where spans overlap the earlier, longer one counts."""
    out, done = [], 0
    for kind, start, end, score in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if start >= done and score >= least:
            out += [text[done:start], f"<{kind.upper()}>"]
            done = end
    return "".join([*out, text[done:]]) if out else text


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, spans) per row of ``docs``."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, fields)], ["doc_id", "spans"])

    return map_texts(kept, scan, f"doc_id {dict(kept.dtypes)['doc_id']}, spans {SPAN}")


def mask(docs: DataFrame, least: float = LEAST_MASKED, text_col: str = "text") -> DataFrame:
    """``docs`` with confirmed spans of at least that score masked in its text; all other columns stay."""
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            columns[at] = pa.array([masked(t.as_py(), least) for t in columns[at]], pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return map_texts(docs, scan, docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    found = detect(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id",
        *counts[: len(BASE)],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *counts[len(BASE) :],
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"),
    )
