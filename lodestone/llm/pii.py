"""Personal data: regular expressions propose, checksums confirm, context adjusts.

Each kind has a pattern, a validator and a base score.  What the validator refutes is
dropped; words of the kind's context nearby raise the score, words that speak against
it lower it, and spans from THRESHOLD on are reported.  Of overlapping spans the one
with the higher score stays, then the longer, then the earlier.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from ipaddress import IPv6Address

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
#: Characters on either side of a span in which context words count.
WINDOW = 48
RAISE, LOWER = 0.25, 0.3


def luhn(digits: str) -> bool:
    """The Luhn check of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of ISO 13616: country and check digits to the end, letters as 10 to 35, 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


_IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}


def _card(s: str) -> float:
    d = re.sub(r"\D", "", s)
    return 0.75 if 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn(d) else 0.0


def _iban(s: str) -> float:
    s = s.replace(" ", "")
    known = _IBAN_LENGTH.get(s[:2].upper(), len(s) if s.isupper() else 0)
    return 0.95 if known == len(s) and 15 <= len(s) <= 34 and mod97(s) else 0.0


def _ipv4(s: str) -> float:
    p = s.split(".")
    return 0.6 if all(int(x) < 256 and (x == "0" or x[0] != "0") for x in p) and p != ["0"] * 4 else 0.0


def _ipv6(s: str) -> float:
    """An address of few groups may be code or a time: it needs context."""
    try:
        one = IPv6Address(s)
    except ValueError:
        return 0.0
    return 0.0 if one.is_loopback or one.is_unspecified or not any(map(str.isdigit, s)) else 0.6 if sum(map(bool, s.split(":"))) >= 4 else 0.35


_MONTH, _DAY, _YEAR = r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])", r"(?:1[5-9]|20|21)\d\d"
_DATE = re.compile(rf"{_YEAR}([ .-])(?:{_MONTH}\1{_DAY}|{_YEAR})|(?:{_MONTH}([ .-]){_DAY}|{_DAY}([ .-]){_MONTH})(?:\2|\3){_YEAR}")


def _phone(s: str) -> float:
    n = sum(c.isdigit() for c in s)
    if _DATE.fullmatch(s):
        return 0.0
    # a long run after a plus is E.164, more so than a card number by chance of its check digit
    return 0.0 if not 7 <= n <= 15 else (0.8 if re.search(r"\d{8}", s) else 0.7) if s[0] == "+" else 0.55 if "(" in s else 0.35


def _ssn(s: str) -> float:
    a, b, c = s.split("-")
    return 0.55 if a not in ("000", "666") and a < "900" and b != "00" and c != "0000" else 0.0


def _email(s: str) -> float:
    local, domain = s.rsplit("@", 1)
    return 0.9 if ".." not in s and not local.endswith(".") and not any(x.startswith("-") or x.endswith("-") for x in domain.split(".")) else 0.0


def _secret(s: str) -> float:
    n = Counter(s)
    entropy = -sum(k / len(s) * math.log2(k / len(s)) for k in n.values())
    return 0.7 if entropy >= 2.8 and any(c.isdigit() for c in s) else 0.0


def _token(s: str) -> float:
    return 0.9 if len(set(s)) >= 8 and any(map(str.isdigit, s)) else 0.0


#: kind, pattern (the span is group 1 where there is one), validator with base score, words for, words against.
KINDS: tuple[tuple[str, re.Pattern, Callable[[str], float], frozenset, frozenset], ...] = tuple(
    (kind, re.compile(pattern), valid, frozenset(pro.split()), frozenset(con.split()))
    for kind, pattern, valid, pro, con in (
        ("card", r"(?<![\d.])(?<!\d[ -])\d(?:[ -]?\d){12,18}(?![ -]?\d)", _card, "card visa mastercard amex credit debit payment karte carte tarjeta cvv", "isbn tracking order serial sku invoice"),
        ("iban", r"\b[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?\b", _iban, "iban account bank konto compte cuenta", ""),
        ("ipv4", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _ipv4, "ip address host server client login adresse", "version release build section chapter firmware"),
        ("ipv6", r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|(?=::))(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])", _ipv6, "ip ipv6 address host server client login adresse", "version release build time"),
        ("phone", r"(?<![\w.+-])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{5,12}|\(\d{2,4}\)[ .-]?\d{5,10}|(?<!\d,)\d{7,15})(?![\w-]|\.\d)", _phone, "call phone tel telephone mobile fax cell whatsapp telefon téléphone teléfono", "isbn order version page pages invoice id"),
        ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn, "ssn social security", "order part model"),
        ("secret", r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth)\b\"?\s*[:=]\s*[\"']?([A-Za-z0-9_+/=.-]{12,})", _secret, "", "example placeholder"),
        ("secret", r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{35}|gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255}|glpat-[A-Za-z0-9_-]{20,255}|xox[abeoprs]-[A-Za-z0-9-]{10,255}|[sr]k_live_[A-Za-z0-9]{16,255}|sk-[A-Za-z0-9_-]{20,255})(?![A-Za-z0-9_-])", _token, "", "example placeholder"),
        ("secret", r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", _token, "", ""),
        ("secret", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,.]|-(?!----))*(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?", lambda s: 0.95, "", ""),
    )
)
_LOCAL = re.compile(r"[\w.%+-]{1,64}\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![A-Za-z0-9])")
_NEAR = re.compile(r"[^\W\d_]+")
_EMAIL = (_email, frozenset("mail email e contact write kontakt correo courriel".split()), frozenset())


def _proposals(text: str) -> Iterator[tuple[str, int, int, float, frozenset, frozenset]]:
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if local and domain:
            start = local.start() + len(local[0]) - len(local[0].lstrip(".%+-"))
            if start < at:
                yield "email", start, domain.end(), _EMAIL[0](text[start : domain.end()]), _EMAIL[1], _EMAIL[2]
        at = text.find("@", at + 1)
    for kind, pattern, valid, pro, con in KINDS:
        for m in pattern.finditer(text):
            a, b = m.span(1 if pattern.groups else 0)
            yield kind, a, b, valid(text[a:b]), pro, con


def spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, ends exclusive, ordered by start."""
    good = []
    for kind, a, b, base, pro, con in _proposals(text):
        if not base:
            continue
        if pro or con:
            near = set(_NEAR.findall(text[max(0, a - WINDOW) : a].lower())) | set(_NEAR.findall(text[b : b + WINDOW].lower()))
            base += RAISE * bool(near & pro) - LOWER * bool(near & con)
        score = round(min(1.0, base), 3)
        if score >= threshold:
            good.append((kind, a, b, score))
    kept: list[tuple[str, int, int, float]] = []
    end = -1
    for s in sorted(good, key=lambda s: (s[1], -s[2])):
        if s[1] >= end:
            kept.append(s)
        elif (s[3], s[2] - s[1], -s[1]) > (kept[-1][3], kept[-1][2] - kept[-1][1], -kept[-1][1]):
            kept[-1] = s
        end = kept[-1][2]
    return kept


def _possible(text: Column) -> Column:
    """Every kind but a private key has a digit or an at sign; texts without need no closer look."""
    return text.rlike(r"[\p{Nd}@]") | text.contains("PRIVATE KEY")


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kind, start, end, score) of every span of personal data or secret.

    Offsets count code points of the text as it is.  Null and empty texts have no
    spans; a null doc_id passes through; repeated rows each give their spans; an empty
    table gives an empty one; very long texts are searched whole.  Other columns are
    ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *s) for k, x in enumerate(batch.column(1).to_pylist()) for s in spans(x, threshold)]
            row, kind, a, b, score = (list(x) for x in zip(*rows)) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(kind, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(score, pa.float64())], ["doc_id", "kind", "start", "end", "score"])

    some = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter(_possible(F.col("text")))
    return some.mapInArrow(scan, "doc_id bigint, kind string, start int, end int, score double")


def redact_text(text: str, threshold: float = THRESHOLD) -> str:
    out, at = [], 0
    for kind, a, b, _ in spans(text, threshold):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redacted(text: Column, threshold: float = THRESHOLD) -> Column:
    """A text column with each span replaced by its kind in brackets.

    A null text stays null, an empty one and any without spans stay as they are; of
    overlapping spans the one that ``spans`` keeps is replaced; repeated rows are redacted
    alike; an empty column gives an empty one; very long texts are redacted whole.  Other
    columns aren't touched.
    """

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else redact_text(x, threshold) for x in texts.to_pylist()], pa.string())

    return F.when(_possible(text), redact(text)).otherwise(text)
