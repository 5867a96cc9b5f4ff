"""Personal data: spans by pattern, confirmed by checksum, scored by context.

Patterns propose spans; validators confirm those that have a check (address
parts, Luhn, mod-97, digit counts); words near a span move its score. Base kinds
(email, ip, card, phone) are reported whenever pattern and validator agree: the
score never removes them. Added kinds (iban, ssn, and cards of 13 to 15 digits as
card_short) need a confirming checksum or context to reach the threshold.

Every pattern runs in time linear in the text: no start inside a run that was
already scanned is tried again.

Cases: null or empty text has no spans; offsets are code points, end exclusive;
repeated rows are scanned each on its own; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "card_short")
KINDS = BASE_KINDS + ADDED_KINDS
THRESHOLD = 0.5
#: Characters on either side in which context words count.
REACH = 48
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "card_short": ("card", "visa", "credit", "payment", "amex", "karte", "carte", "tarjeta"),
}
#: What pattern plus validator are worth alone, and what one near context word adds.
PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "card_short": 0.3}
BOOST = 0.3

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by country: the registry's, then those in use beside it.
_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 "
    "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 "
    "MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 "
    "SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30 "
    "AO25 BF28 BJ28 CF27 CG27 CI28 CM27 CV25 DZ26 GA27 GQ27 GW25 IR26 KM27 MA28 MG27 ML28 MZ25 NE28 SN28 TD27 TG28"
)
LENGTHS = {x[:2]: int(x[2:]) for x in _LENGTHS.split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        left = text[done:at]
        start = at - (len(left) - len(left.rstrip(_LOCAL)))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def _iban_end(run: str) -> int | None:
    """Where the IBAN at the start of ``run`` ends; words and digits may follow it in the run.

    The length of the country first, else the whole run.
    """
    at = [i for i, c in enumerate(run, 1) if c != " "]
    own, code = LENGTHS.get(run[:2], len(at)), run.replace(" ", "")
    for n in (own, len(at)):
        if n <= len(at) and (n == len(at) or run[at[n - 1]] == " ") and mod97(code[:n]):
            return at[n - 1]
    return None


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    m = _IBAN.search(text)
    while m:
        end = _iban_end(m[0])
        if end:
            yield m.start(), m.start() + end
        m = _IBAN.search(text, m.start() + (end or 1))


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, kind by kind and left to right."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    found["ip"] = list(_ips(text))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card" if len(digits) >= 16 else "card_short"].append(m.span())
    if "+" in text:
        found["phone"] = list(_phones(text))
    found["iban"] = list(_ibans(text))
    if "-" in text:
        for m in _SSN.finditer(text):
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                found["ssn"].append(m.span())
    for kind in KINDS:
        for s, e in found[kind]:
            yield kind, s, e


def score(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - REACH) : start] + " " + text[end : end + REACH]).lower()
    hits = set(re.findall(r"[^\W\d_]+", near)) & set(CONTEXT[kind])
    return min(1.0, PRIOR[kind] + BOOST * len(hits))


def spans(text: str | None) -> list[Span]:
    """All spans, by kind in the order of KINDS, then by start."""
    out = []
    for kind, s, e in candidates(text or ""):
        v = score(text, kind, s, e)
        if kind in BASE_KINDS or v >= THRESHOLD:
            out.append(Span(kind, s, e, v))
    return out


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlaps become one."""
    if text is None or not (found := sorted(spans(text), key=lambda s: (s.start, -s.end))):
        return text
    out, at = [], 0
    for s in found:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def joined(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def _spans(text: pd.Series) -> pd.Series:
    return pd.Series([[(s.kind, s.start, s.end, s.score) for s in spans(t)] for t in text], dtype=object)


def _redact(text: pd.Series) -> pd.Series:
    return pd.Series([redact(t) for t in text], dtype=object)


def _summary(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        found = spans(t)
        base = [s for s in found if s.kind in BASE_KINDS]
        counts = [sum(s.kind == k for s in base) for k in BASE_KINDS]
        rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: the spans of each text with kind, offsets and score."""
    run = F.pandas_udf(tidy(_spans), "array<struct<kind string, start int, end int, score double>>")
    return docs.withColumn("pii", run(F.col(text)))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind."""
    return docs.withColumn(text, F.pandas_udf(tidy(_redact), "string")(F.col(text)))


def summary(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``pii``: counts of the base kinds, digest of their spans, and all spans as one string."""
    run = F.pandas_udf(tidy(_summary), "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return docs.withColumn("pii", run(F.col(text)))
