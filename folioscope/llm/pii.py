"""Format-preserving pseudonyms of personal values.

A value is found by its pattern, validated (check digits, calendar, ranges), and permuted by a keyed Feistel network within
its own format, so its length, separators and validity stay and equal values stay linked across documents, whatever stands
between their digits; numbers of other lengths are other values, as 1.1.2020 and 01.01.2020 are. The network F permutes [0, n) by walking cycles; the pseudonym of x is F^-1(F(x) + 1 mod n), which is a permutation
without fixed points, so no value stays. permuted(..., back=True) inverts it.

Kinds: e-mail addresses (the part before @, of any length; one without a letter or digit stays), payment cards (Luhn), IBANs (mod 97), phone numbers, IPv4 addresses, social
security numbers, calendar dates from 1900 to 2099, access keys, hexadecimal secrets of 32 digits or more, and values after
password=, token= and the like. Numbers that don't validate stay.

The key is a secret: pseudonymized() takes it from the session's setting KEY_SETTING. A session without one draws a key of
its own, so values stay linked within the session only and nobody can go back.

Nulls stay null; whole texts of any length are read; other columns, repeated rows and empty tables pass through.
"""

from __future__ import annotations

import re
import secrets
from collections import Counter
from collections.abc import Iterator
from datetime import date
from functools import cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Only for tests and examples of permuted().
KEY = b"folioscope example key"
KEY_SETTING = "spark.folioscope.pii.key"
_drawn: dict[str, bytes] = {}
ROUNDS = 8

_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?)[^\s\"'<>,;&]{4,}",
    "hex": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "iso_date": r"(?<![0-9A-Za-z.-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])",
    "date": r"(?<![0-9A-Za-z./-])[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}(?![0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}|\+(?!1[ .-]?[(0-9])[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z]|\.[0-9])",
    # A space or dash only between groups of four, or of four, six and five, so that no neighbour is drawn in.
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}|[0-9]{4}(?P<gap2>[ -])[0-9]{6}(?P=gap2)[0-9]{5})(?![0-9A-Za-z])",
}
#: In order of precedence at one place; \1 of dates becomes a name.
_ALL = re.compile("|".join(f"(?P<{k}>{p.replace('([./-])', '(?P<cut>[./-])').replace(chr(92) + '1', '(?P=cut)')})" for k, p in _PATTERNS.items()))
_MAYBE = re.compile(r"[0-9@]|(?i:passw|passwd|pwd|secret|token|api)")
_DIGIT, _LETTER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


def feistel(x: int, n: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(n)."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, size, salt = (1 << half) - 1, (half + 7) // 8, tweak.encode()
    while True:
        a, b = x >> half, x & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            told = b"%d|%d|%d|" % (i, n, a if back else b) + salt
            r = int.from_bytes(blake2b(told, key=key[:64], digest_size=min(64, size)).digest(), "big")
            if size > 64:
                r = r << 8 * (size - 64) | int.from_bytes(blake2b(b"more|" + told, key=key[:64]).digest() * (size // 64), "big")
            if back:
                a, b = (b ^ r) & mask, a
            else:
                a, b = b, (a ^ r) & mask
        x = a << half | b
        if x < n:
            return x


def moved(x: int, n: int, key: bytes, tweak: str, back: bool = False) -> int:
    """The pseudonym of x in range(n): another number, if there is one."""
    if n < 2:
        return x
    return feistel((feistel(x, n, key, tweak) + (-1 if back else 1)) % n, n, key, tweak, True)


def _spelled(text: str, key: bytes, tweak: str, back: bool, hexed: bool = False) -> str:
    """text with its ASCII letters and digits permuted within their kinds; the case of letters stays."""
    kinds = [_HEX if hexed else _DIGIT if c in _DIGIT else _LETTER for c in text if c.isascii() and c.isalnum()]
    n = x = 0
    for i, (c, kind) in enumerate(zip((c for c in text if c.isascii() and c.isalnum()), kinds, strict=True)):
        n, x = (n if i else 1) * len(kind), x * len(kind) + kind.index(c.lower())
    shape = "".join("h" if k is _HEX else "d" if k is _DIGIT else "l" for k in kinds)
    x = moved(x, n, key, f"{tweak}|{shape}", back)
    out = []
    for kind in reversed(kinds):
        x, r = divmod(x, len(kind))
        out.append(kind[r])
    new = iter(reversed(out))
    return "".join((next(new).upper() if c.isupper() else next(new)) if c.isascii() and c.isalnum() else c for c in text)


def _refill(text: str, digits: str) -> str:
    new = iter(digits)
    return "".join(next(new) if c in _DIGIT else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGIT)


def luhn(digits: str) -> int:
    """The check sum of a number with its check digit; 0 if it is valid."""
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def _email(v: str, key: bytes, back: bool) -> str | None:
    name, _, host = v.rpartition("@")
    return _spelled(name, key, "email|" + host.lower(), back) + "@" + host


def _card(v: str, key: bytes, back: bool) -> str | None:
    d = _digits(v)
    if luhn(d) or len(set(d)) == 1:
        return None
    body = f"{moved(int(d[1:-1]), 10 ** (len(d) - 2), key, f'card|{d[0]}', back):0{len(d) - 2}d}"
    return _refill(v, d[0] + body + str(-luhn(d[0] + body + "0") % 10))


def _iban(v: str, key: bytes, back: bool) -> str | None:
    c = v.replace(" ", "")
    number = lambda s: int("".join(str(int(x, 36)) for x in s))
    if number(c[4:] + c[:4]) % 97 != 1:
        return None
    body = _spelled(c[4:], key, "iban|" + c[:2], back)
    new = iter(c[:2] + f"{98 - number(body + c[:2] + '00') % 97:02d}" + body)
    return "".join(x if x == " " else next(new) for x in v)


@cache
def _days(day: int, month: int) -> tuple[list[int], dict[int, int]]:
    """The calendar days from 1900 to 2099 that fit in so many digits for day and month; places."""
    every = [i for i in range(date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal()) if (d := date.fromordinal(i)).day < 10 ** day and d.month < 10 ** month]
    return every, {x: i for i, x in enumerate(every)}


def _date(v: str, key: bytes, back: bool) -> str | None:
    a, b, c = re.split("[./-]", v)
    for style in ("ymd",) if len(a) == 4 else ("dmy", "mdy"):
        of = dict(zip(style, (a, b, c), strict=True))
        try:
            day = date(int(of["y"]), int(of["m"]), int(of["d"]))
        except ValueError:
            continue
        # A date that only reads as month first must stay one.
        days, place = (_month_first if style == "mdy" else _days)(len(of["d"]), len(of["m"]))
        new = date.fromordinal(days[moved(place[day.toordinal()], len(days), key, f"date|{style if style == 'mdy' else ''}|{len(of['d'])}{len(of['m'])}", back)])
        parts = {"y": f"{new.year:04d}", "m": f"{new.month:0{len(of['m'])}d}", "d": f"{new.day:0{len(of['d'])}d}"}
        cuts = re.findall("[./-]", v)
        return parts[style[0]] + cuts[0] + parts[style[1]] + cuts[1] + parts[style[2]]
    return None


@cache
def _month_first(day: int, month: int) -> tuple[list[int], dict[int, int]]:
    """Of _days(), those that only read as month first."""
    every = [i for i in _days(day, month)[0] if date.fromordinal(i).day > 12]
    return every, {x: i for i, x in enumerate(every)}


def _ssn(v: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, v.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(moved(x, 898 * 99 * 9999, key, "ssn", back), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(v: str, key: bytes, back: bool) -> str | None:
    parts = v.split(".")
    low, many = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    n, x = 1, 0
    for p in parts:
        n, x = n * many[len(p)], x * many[len(p)] + int(p) - low[len(p)]
    x, out = moved(x, n, key, "ip|" + "".join(str(len(p)) for p in parts), back), []
    for p in reversed(parts):
        x, r = divmod(x, many[len(p)])
        out.append(str(r + low[len(p)]))
    return ".".join(reversed(out))


def _phone(v: str, key: bytes, back: bool) -> str | None:
    d = _digits(v)
    north = d[1:] if len(d) == 11 and d[0] == "1" else d if len(d) == 10 and v[0] != "+" else ""
    if north and north[0] in "23456789" and north[3] in "23456789":
        x = (int(north[:3]) - 200) * 8_000_000 + (int(north[3:6]) - 200) * 10_000 + int(north[6:])
        x = moved(x, 6_400_000_000, key, "phone", back)
        new = f"{x // 8_000_000 + 200}{x // 10_000 % 800 + 200}{x % 10_000:04d}"
        return _refill(v, d[: len(d) - 10] + new)
    if v[0] != "+" or not 8 <= len(d) <= 15:
        return None
    code = len(re.match(r"\+([0-9]*)", v)[1])
    code = code if code < len(d) - 5 and code <= 3 else 2
    return _refill(v, d[:code] + f"{moved(int(d[code:]), 10 ** (len(d) - code), key, f'phone|{d[:code]}|{len(d)}', back):0{len(d) - code}d}")


def _secret(v: str, key: bytes, back: bool) -> str | None:
    at = re.match(r"[A-Za-z_-]+[\"']?[ \t]*[=:][ \t]*[\"']?", v).end()
    return v[:at] + _spelled(v[at:], key, "secret", back)


_OF = {
    "email": _email, "card": _card, "iban": _iban, "iso_date": _date, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "secret": _secret,
    "access_key": lambda v, key, back: v[:4] + _spelled(v[4:], key, "access_key", back),
    "hex": lambda v, key, back: _spelled(v, key, "hex", back, True),
}


def permuted(text: str, key: bytes = KEY, back: bool = False, known: dict | None = None) -> tuple[str, Counter]:
    """The text with pseudonyms, and how many values of each kind it had. known: values already met."""
    found: Counter = Counter()
    if not _MAYBE.search(text):
        return text, found
    known = {} if known is None else known

    def new(m: re.Match) -> str:
        kind, v = next(k for k in _PATTERNS if m[k] is not None), m[0]
        if (kind, v) not in known:
            if len(known) > 100_000:
                known.clear()
            known[kind, v] = _OF[kind](v, key, back)
            if known[kind, v] is None and kind == "phone" and re.fullmatch(_PATTERNS["card"], v):
                known[kind, v] = _card(v, key, back)
        out = known[kind, v]
        if out is None or out == v:
            return v
        found[kind] += 1
        return out

    return _ALL.sub(new, text), found


def key_of(spark: SparkSession) -> bytes:
    """The session's key; it must have 16 bytes or more."""
    told = spark.conf.get(KEY_SETTING, None)
    if told is None:
        return _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))
    if len(told.encode()) < 16:
        raise ValueError(f"{KEY_SETTING} has fewer than 16 bytes")
    return told.encode()


def pseudonymized(docs: DataFrame, key: bytes | None = None, back: bool = False, counts: str | None = None) -> DataFrame:
    """docs with pseudonyms in `text`; with `counts`, a column of that name says how many values of each kind were met."""
    key = key_of(docs.sparkSession) if key is None else key
    docs = docs.withColumn("text", F.col("text").cast("string"))
    names, at = docs.columns, docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            done = [(None, Counter()) if t is None else permuted(t, key, back, known) for t in b.column(at).to_pylist()]
            columns = [pa.array([t for t, _ in done], pa.string()) if i == at else c for i, c in enumerate(b.columns)]
            if counts:
                columns.append(pa.array([" ".join(f"{k}:{n}" for k, n in sorted(c.items())) for _, c in done], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*names, *([counts] if counts else [])])

    schema = T.StructType([*docs.schema.fields, *([T.StructField(counts, T.StringType())] if counts else [])])
    return docs.mapInArrow(of, schema)
