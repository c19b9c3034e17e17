"""Operator 6: format-preserving pseudonyms for personal data.

Card numbers, telephone numbers, national numbers (ddd-dd-dddd), IPv4
addresses, IBANs, calendar dates and the names in e-mail addresses are found
and validated (check digits, calendar, ranges); every valid value is replaced
by another valid value of the same format.  The replacement is a keyed
permutation of the format's values: a Feistel network over the two digits of a
mixed-radix split, walked until it falls inside the domain.  So a value gets
the same pseudonym in every document, different values get different ones, and
whoever has the key can invert it.

The rules are patterns over whole texts and need no other document, so the
operator is one pass without a shuffle.

Cases: null text stays null (no spans); invalid numbers and impossible dates
stay as they are; IBANs may stand in groups of four; mail names of any length
are replaced whole; matches don't overlap (leftmost, then the order of KINDS);
repeated rows are treated alike; extra columns are kept by ``pseudonymise``.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
#: characters of a mail name that are permuted together; a longer name goes block by block
NAME_BLOCK = 64
KINDS = ["email", "iban", "card", "phone", "national", "ipv4", "date"]
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

# Length of an IBAN -> countries.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _printed_iban() -> str:
    """IBANs as they are printed, in groups of four; the country says where the last group ends."""
    forms = []
    for length, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(length - 4, 4)
        last = f" [A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{groups}}}{last}")
    return "|".join(forms)


_PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    r"(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)"
    rf"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{_printed_iban()})(?![A-Za-z0-9])"
    r"|(?<![0-9A-Za-z.-])(?P<card>[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}"
    r"|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?P<phone>\+1[ .-]?(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|\([2-9][0-9]{2}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[2-9][0-9]{2}[.-][0-9]{3}[.-][0-9]{4}"
    r"|\+[1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,4})(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z-])(?P<national>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z-])"
    r"|(?<![0-9A-Za-z.])(?P<ipv4>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9A-Za-z]|\.[0-9])"
    r"|(?<![0-9A-Za-z-])(?P<date>(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}"
    r"|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2})(?![0-9A-Za-z])")
_MAYBE = re.compile(r"[0-9@]")


class Feistel:
    """Keyed permutation of range(n)."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, r: int, x: int) -> int:
        data = b"%s|%d|%d" % (tweak, r, x)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=16).digest(), "big")

    def _once(self, x: int, a: int, b: int, tweak: bytes, back: bool) -> int:
        left, right = divmod(x, b)
        for r in (reversed(range(ROUNDS)) if back else range(ROUNDS)):
            sign = -1 if back else 1
            if r % 2 == 0:
                left = (left + sign * self._round(tweak, r, right)) % a
            else:
                right = (right + sign * self._round(tweak, r, left)) % b
        return left * b + right

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        salt = f"{tweak}|{n}".encode()
        x = self._once(x, a, b, salt, back)
        while x >= n:  # walk the cycle until it comes back into the domain
            x = self._once(x, a, b, salt, back)
        return x


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _classes(text: str) -> list[str]:
    sets = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    return [next((s for s in sets if c in s), c) for c in text]


def _by_class(text: str, f: Feistel, tweak: str, back: bool) -> str:
    """Every letter or digit to one of its class, the others stay."""
    classes, x, n = _classes(text), 0, 1
    for c, s in zip(text, classes):
        x, n = x * len(s) + s.index(c), n * len(s)
    x, out = f.permute(x, n, tweak + "|" + "".join(s[0] for s in classes), back), []
    for s in reversed(classes):
        x, d = divmod(x, len(s))
        out.append(s[d])
    return "".join(reversed(out))


def _email(v: str, f: Feistel, back: bool) -> str | None:
    name, domain = v.split("@")
    blocks = [name[i:i + NAME_BLOCK] for i in range(0, len(name), NAME_BLOCK)]
    # the tweak of the first block is the one of a whole short name
    return "".join(_by_class(b, f, f"email{i or ''}", back) for i, b in enumerate(blocks)) + "@" + domain


def _iban(v: str, f: Feistel, back: bool) -> str | None:
    plain = v.replace(" ", "")  # a printed value gets the pseudonym of the plain one
    if _iban_check(plain[:2], plain[4:]) != int(plain[2:4]):
        return None
    account = _by_class(plain[4:], f, "iban" + plain[:2], back)
    new = iter(f"{plain[:2]}{_iban_check(plain[:2], account):02d}{account}")
    return "".join(c if c == " " else next(new) for c in v)


def _card(v: str, f: Feistel, back: bool) -> str | None:
    d = re.sub(r"[^0-9]", "", v)
    if luhn_digit(d[:-1]) != int(d[-1]) or not 13 <= len(d) <= 19 or d[0] not in "23456":
        return None
    body = d[0] + str(f.permute(int(d[1:-1]), 10 ** (len(d) - 2), "card" + d[0], back)).zfill(len(d) - 2)
    return _refill(v, body + str(luhn_digit(body)))


def _phone(v: str, f: Feistel, back: bool) -> str | None:
    d = re.sub(r"[^0-9]", "", v)
    if not 7 <= len(d) <= 15:
        return None
    national = not v.startswith("+") or (d[0] == "1" and len(d) == 11)
    if national:  # area code from 200 on, the rest free
        head, own = d[:-10], d[-10:]
        new = f.permute(int(own) - 2 * 10 ** 9, 8 * 10 ** 9, "phone", back) + 2 * 10 ** 9
        return _refill(v, head + str(new))
    head, own = d[:2], d[2:]
    return _refill(v, head + str(f.permute(int(own), 10 ** len(own), "phone" + head, back)).zfill(len(own)))


def _national(v: str, f: Feistel, back: bool) -> str | None:
    area, group, serial = (int(x) for x in v.split("-"))
    if not (1 <= area < 900 and area != 666 and group and serial):
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(f.permute(x, 898 * 99 * 9999, "national", back), 9999)
    area, group = divmod(x, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ipv4(v: str, f: Feistel, back: bool) -> str | None:
    parts = v.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ipv4", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(v: str, f: Feistel, back: bool) -> str | None:
    form = "%Y-%m-%d" if v[4] == "-" else "%d/%m/%Y" if v[2] == "/" else "%d.%m.%Y"
    try:
        day = dt.datetime.strptime(v, form).date().toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    day = f.permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date", back) + FIRST_DAY
    return dt.date.fromordinal(day).strftime(form)


_RULES: dict[str, Callable[[str, Feistel, bool], str | None]] = {
    "email": _email, "iban": _iban, "card": _card, "phone": _phone, "national": _national, "ipv4": _ipv4,
    "date": _date}


def replace_all(text: str, f: Feistel, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms and (kind, start, end) of each in the new text."""
    out, spans, at, size = [], [], 0, 0
    for m in _PATTERN.finditer(text):
        new = _RULES[m.lastgroup](m[0], f, back)
        if new is None:
            continue
        out += [text[at:m.start()], new]
        size += m.start() - at
        spans.append((m.lastgroup, size, size + len(new)))
        size, at = size + len(new), m.end()
    return "".join([*out, text[at:]]), spans


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str = "pii_spans",
                 back: bool = False) -> DataFrame:
    """The documents with pseudonyms in ``text_col`` and their places in ``spans_col``; ``back`` inverts."""
    if spans_col in docs.columns:
        raise ValueError(f"the input already has a column {spans_col}")
    schema = T.StructType([*docs.schema.fields, T.StructField(spans_col, T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("s", T.IntegerType()),
        T.StructField("e", T.IntegerType())])))])

    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for batch in batches:
            texts = batch[text_col].to_pylist()
            spans: list[list] = [[] for _ in texts]
            for i, text in enumerate(texts):
                if text and _MAYBE.search(text):
                    texts[i], found = replace_all(text, feistel, back)
                    spans[i] = [{"kind": k, "s": s, "e": e} for k, s, e in found]
            yield pa.RecordBatch.from_pydict({c: pa.array(texts, pa.string()) if c == text_col else batch[c]
                                              for c in columns} | {spans_col: pa.array(spans, _SPANS)})

    return docs.mapInArrow(run, schema)


def report(done: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """doc_id, the new text, and the number of pseudonyms by kind."""
    def count(kind: str):
        return F.size(F.filter(spans_col, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return done.select(id_col, text_col, *counts)
