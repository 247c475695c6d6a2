"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
URL schemes and identifier cues.  From each anchor a local parser expands to the
boundaries of an email address, an IP address, a card or phone number, a URL
with a personal part, a secret, an IBAN or an account number, and validates it.
Parsers look only at the run of characters around their anchor, and never twice
at the same run, so the work is linear in the text.

Base kinds (email, ip, card, phone) are exactly the leftmost non-overlapping
matches of the patterns in their parsers' comments, kept only if valid.  Spans
count code points, end exclusive.  A null or empty text has none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "secret", "iban", "account")
_RANK = {k: i for i, k in enumerate(KINDS)}

# Cues are found as written here, capitalised and in capitals.
SECRET_CUES = ("password", "passwd", "api_key", "apikey", "secret", "token")
ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"[0-9][\x20().0-9-]+[0-9]")
_SCHEME_LEFT = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*$")
_URL_REST = re.compile(r"[^\s<>\"'|]+")
_PERSONAL_PATH = re.compile(r"/(?:~|@|users?/|u/|profiles?/|people/)[A-Za-z0-9._-]+", re.I)
_SECRET = re.compile(r"[\x20\"']*[=:][\x20\"']*([A-Za-z0-9_./+-]{8,})")
_IBAN = re.compile(r"[:\x20]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|nummer|numero|no\.?|nr\.?|id))?[\x20:#=]+([0-9](?:[\x20-]?[0-9]){6,16})(?![0-9])", re.I)


class Span(NamedTuple):
    kind: str
    start: int
    end: int


@cache
def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, words in {"@": ["@"], "+": ["+"], "digit": list("0123456789"), "scheme": ["://"], "secret": SECRET_CUES, "iban": ["iban"], "account": ACCOUNT_CUES}.items():
        for word in words:
            for form in {word, word.capitalize(), word.upper()}:
                automaton.add_word(form, (kind, len(form)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def iban_valid(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans(text: str) -> list[Span]:
    """All spans of one text, by start, then kind."""
    out: list[Span] = []
    email_end = dotted_end = grouped_end = phone_end = url_end = 0
    for last, (kind, length) in _anchors().iter(text):
        if kind == "digit":
            if last >= dotted_end:
                # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+): fours of numbers along one dotted run
                run = _DOTTED.match(text, last)
                at, dotted_end = last, run.end()
                parts = run[0].split(".")
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    end = at + sum(map(len, four)) + 3
                    if all(map(_octet, four)):
                        out.append(Span("ip", at, end))
                    at = end + 1
            if last >= grouped_end:
                # [0-9]([\x20-]?[0-9])+
                run = _GROUPED.match(text, last)
                grouped_end = run.end() if run else last + 1
                if run and grouped_end - last >= 14:
                    digits = run[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append(Span("card", last, grouped_end))
        elif kind == "@":
            # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (domain := _DOMAIN.match(text, last + 1)):
                email_end = domain.end()
                out.append(Span("email", start, email_end))
        elif kind == "+":
            # \+[0-9][\x20().0-9-]+[0-9]
            if last >= phone_end and (number := _PHONE.match(text, last + 1)):
                phone_end = number.end()
                if 10 <= sum(map(str.isdigit, number[0])) <= 15:
                    out.append(Span("phone", last, phone_end))
        elif kind == "scheme":
            start, rest = last - 2, _URL_REST.match(text, last + 1)
            scheme = _SCHEME_LEFT.search(text, max(url_end, start - 20), start)
            if scheme and rest:
                authority, slash, path = rest[0].partition("/")
                if "." in authority and ("@" in authority or _PERSONAL_PATH.match(slash + path)):
                    url_end = last + 1 + len(rest[0].rstrip(".,;:!?)"))
                    out.append(Span("url", scheme.start(), url_end))
        else:
            start = last + 1 - length
            if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
                continue
            pattern = {"secret": _SECRET, "iban": _IBAN, "account": _ACCOUNT}[kind]
            found = pattern.match(text, last + 1)
            if found and (kind != "iban" or iban_valid(found[1])):
                out.append(Span(kind, *found.span(1)))
    out.sort(key=lambda s: (s.start, _RANK[s.kind]))
    return out


def joined(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_pii(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and `found`, the array of spans of each row's whole text (empty where null); row by row, other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [[s._asdict() for s in spans(t)] if (t := x.as_py()) else [] for x in part.column("__text")]
                yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array(found, kind)], names=[key, "found"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("found", SPAN)])
    return df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of their spans, all spans as text, and counts of the added kinds (n_url, n_secret, n_iban, n_account) and of all (n_spans)."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = F.transform("found", lambda s: s["kind"])
    count = lambda k: (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}")
    added = [*map(count, KINDS[len(BASE_KINDS) :]), F.size("found").cast("long").alias("n_spans")]
    return found.select(key, *map(count, BASE_KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), *added)


def mask(text: str, found: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    out, at = [], 0
    for s in found:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
            at = s.end
    return "".join([*out, text[at:]])


def sha256_of(found: list[Span]) -> str:
    return hashlib.sha256(joined([s for s in found if s.kind in BASE_KINDS]).encode()).hexdigest()
