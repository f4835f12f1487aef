"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score.

Kinds of the contract (email, ip, card, phone) are confirmed by their own rules and always stay; words nearby
move their score only.  Beyond them the method finds
  iban    an account number; mod 97 and the country's length weigh most,
  tel     a national telephone number; digits in groups prove little, so it needs a word such as "phone",
  ssn     a social security number, which needs its name nearby,
  secret  a key, token or password: what is assigned to such a name, or has the form that an issuer gives it;
          many different characters speak for it, words such as "checksum" against it.
An added span stands where its score is at least a half: what the pattern is worth, plus what confirms it, plus
or less what stands up to 40 characters before it.

Defined cases: null or empty text has no span and score 0; offsets are code points, end exclusive; equal rows
are judged alike; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.common import table, text_of

KINDS = ("email", "ip", "card", "phone", "iban", "tel", "ssn", "secret")
BASE = KINDS[:4]
CONTEXT_CHARS = 40
THRESHOLD = 0.5

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is entered at its start only: a later start of it finds nothing that the first doesn't
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
TEL = re.compile(r"(?<![0-9A-Za-z+.-])\(?0[0-9]{1,4}\)?[\x20/-][0-9]{2,5}(?:[\x20-]?[0-9]{2,5}){1,3}(?![0-9A-Za-z])")
DIGIT = re.compile(r"[0-9]")

# Lengths of the account numbers by country, of the whole IBAN registry.
IBAN_COUNTRIES = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
IBAN_LENGTHS = {c: n for n, countries in IBAN_COUNTRIES.items() for c in countries.split()}
SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
NAMED = re.compile(r"(?:api[_-]?key|access[_-]?key|private[_-]?key|secret|token|passwor[dt]|passwd|pwd|bearer|kennwort|contrase[ñÑ]a|mot de passe)[\"']?[\x20\t]{0,3}[:=][\x20\t]{0,3}[\"']?([A-Za-z0-9+/_.~-]{8,}={0,2})", re.I | re.A)
ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])")

# What a text must hold, in small letters, before these patterns are looked for.
NAMES = ("key", "secret", "token", "passwor", "passwd", "pwd", "bearer", "kennwort", "contrase", "mot de passe")
ISSUERS = ("akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox")

# Words that speak for a kind, and words that speak against it.
FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login|client|adresse|dirección)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:tel|telephone|phone|mobile|cell|call|fax|telefon|handy|anruf|téléphone|portable|appel|teléfono|móvil|llam\w*)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta|transfer)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
    "secret": re.compile(r"\b(?:secret|credential|login|auth\w*|private|key)\b", re.I),
}
FOR["tel"] = FOR["phone"]
AGAINST = {
    "ip": re.compile(r"\b(?:version|release|section|chapter)\b", re.I),
    "card": re.compile(r"\b(?:isbn|order|invoice|serial|tracking)\b", re.I),
    "iban": re.compile(r"\b(?:order|serial|isbn|tracking)\b", re.I),
    "tel": re.compile(r"\b(?:version|isbn|order|invoice|id|no|nr|serial)\b", re.I),
    "ssn": re.compile(r"\b(?:isbn|order|invoice|serial|part)\b", re.I),
    "secret": re.compile(r"\b(?:checksum|commit|sha-?256|md5|example|placeholder)\b", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def mod97(compact: str) -> bool:
    moved = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost spans: of one @ the leftmost start is that of the run before it, or where the last span ended."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the contract's kinds."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 or int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return out


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in (value.count(x) for x in set(value)))


def context(text: str, start: int, kind: str) -> float:
    """What the words before a span are worth to its kind."""
    before = text[max(0, start - CONTEXT_CHARS) : start]
    worth = FOR_WORTH.get(kind, 0.1) * bool(FOR[kind].search(before))
    return worth - 0.3 * bool(kind in AGAINST and AGAINST[kind].search(before))


#: What a word of its own is worth to kinds that little else confirms.
FOR_WORTH = {"tel": 0.4, "ssn": 0.4}

Scored = tuple[int, int, int, float]


def ibans(text: str) -> Iterator[Scored]:
    m = IBAN.search(text)
    while m:
        # what is found may reach into the next number, so the search goes on behind the accepted span
        free = m.start() + 1
        length = IBAN_LENGTHS.get(text[m.start() : m.start() + 2])
        if length:
            end, seen = m.start(), 0
            while end < m.end() and seen < length:
                seen += text[end] != " "
                end += 1
            compact = text[m.start() : end].replace(" ", "")
            sure = len(compact) == length and mod97(compact) and not text[end : end + 1].isalnum()
            score = 0.1 + 0.75 * sure + context(text, m.start(), "iban")
            if score >= THRESHOLD:
                yield m.start(), KINDS.index("iban"), end, score
                free = end
        m = IBAN.search(text, free)


def secrets(text: str, lower: str) -> Iterator[Scored]:
    found: dict[int, tuple[int, float]] = {}
    for m in NAMED.finditer(text) if any(n in lower for n in NAMES) else ():
        value = m.group(1)
        plain = not any(c.isdigit() for c in value)  # such as "password: required"
        found[m.start(1)] = (m.end(1), 0.6 - 0.3 * plain)
    for m in ISSUED.finditer(text) if any(n in lower for n in ISSUERS) else ():
        found[m.start()] = (m.end(), 0.6)
    for start, (end, worth) in sorted(found.items()):
        value = text[start:end]
        score = worth + 0.2 * (len(value) >= 16 and entropy(value) >= 3) + context(text, start, "secret")
        if score >= THRESHOLD:
            yield start, KINDS.index("secret"), end, score


def more_spans(text: str) -> list[Scored]:
    """Spans of the added kinds, with their scores."""
    lower = text.lower()
    out = list(secrets(text, lower))
    if not DIGIT.search(text):
        return out
    out += ibans(text)
    for m in TEL.finditer(text):
        digits = sum(c.isdigit() for c in m.group())
        score = 0.2 + 0.1 * (9 <= digits <= 12) + context(text, m.start(), "tel")
        if score >= THRESHOLD:
            out.append((m.start(), KINDS.index("tel"), m.end(), score))
    # without its name nearby a number of this form scores too little
    for m in SSN.finditer(text) if "ssn" in lower or "social security" in lower else ():
        score = 0.2 + context(text, m.start(), "ssn")
        if score >= THRESHOLD:
            out.append((m.start(), KINDS.index("ssn"), m.end(), score))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def judge(text: str) -> tuple:
    base = base_spans(text)
    more = more_spans(text)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(len(BASE))]
    scores = [0.8 + context(text, s, KINDS[k]) for s, k, _ in base] + [score for *_, score in more]
    spans = base + [x[:3] for x in more]
    return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans), min(1.0, max(scores, default=0.0)), bool(spans))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, score double, found boolean"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, score (of the surest span), found of every row."""
    names = [c.split()[0] for c in SCHEMA.split(", ")[1:]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = pd.DataFrame([judge(t) for t in batch["text"]], columns=names)
            told.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield told

    # ids as text, since numbers beside a null would come as floats
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(run, SCHEMA.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
