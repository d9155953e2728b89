"""Format-preserving pseudonyms for personal data.

Found values are validated (check digits, octets, calendar dates, number plans),
numbered within the set of valid values of their format, and that number is
moved by a keyed Feistel permutation of exactly that set (cycle walking).  The
pseudonym is the value with the new number: valid again, of the same format and
punctuation, and equal wherever the original was equal, so documents stay linked
without any table of values being gathered.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import warnings
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.text import annotate, small_batches

#: Session setting that holds the secret key, and the public key of samples and tests.
KEY_SETTING, SAMPLE_KEY = "fieldloom.pii.key", b"corpus-pseudonyms-1"
KINDS = ("email", "phone", "card", "ip", "date", "ssn", "iban")
ROUNDS = 8
_EPOCH, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
_LOW, _UP, _DIG = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names in ``fieldloom.pii.key``.

    Where it is unset, as for the given sample tables, the public ``SAMPLE_KEY``
    is used with a warning: its pseudonyms can be undone by anyone.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is unset: pseudonyms use the public sample key", stacklevel=2)
        return SAMPLE_KEY
    return key.encode()


class Undo(bytes):
    """A key under which values are moved back."""


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of ``range(size)``: balanced Feistel with cycle walking; its inverse under an ``Undo`` key."""
    if size <= 1:
        return 0
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    base = hashlib.blake2b(tweak.encode() + size.to_bytes((size.bit_length() + 7) // 8, "big"), key=bytes(key[:64]), digest_size=32).digest()

    def f(r: int, v: int) -> int:
        out = b"".join(hashlib.blake2b(v.to_bytes(width, "big"), key=base, salt=bytes([r, k])).digest() for k in range(-(-width // 64)))
        return int.from_bytes(out, "big") & mask

    while True:
        left, right = x >> half, x & mask
        if isinstance(key, Undo):
            for r in reversed(range(ROUNDS)):
                left, right = right ^ f(r, left), left
        else:
            for r in range(ROUNDS):
                left, right = right, left ^ f(r, right)
        x = left << half | right
        if x < size:
            return x


def _alphabet(c: str) -> str:
    return _DIG if c in _DIG else _LOW if c in _LOW else _UP if c in _UP else ""


def by_class(text: str, key: bytes, tweak: str) -> str:
    """Permute letters among letters of their case and digits among digits; the rest stays."""
    n, size = 0, 1
    for c in text:
        if a := _alphabet(c):
            n, size = n * len(a) + a.index(c), size * len(a)
    n = permute(n, size, key, tweak + re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", text))))
    out = []
    for c in reversed(text):
        if a := _alphabet(c):
            n, k = divmod(n, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out))


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _respell(pattern: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _card(m: re.Match, key: bytes) -> str | None:
    d = re.sub(r"\D", "", m.group())
    phone = len(d) < 16  # 00 begins a phone number
    if not luhn_ok(d) or len(set(d)) == 1 or phone and d.startswith("00"):
        return None
    low = 10 ** (len(d) - 3) if phone else 0
    body = f"{low + permute(int(d[:-1]) - low, 10 ** (len(d) - 1) - low, key, f'card{len(d)}'):0{len(d) - 1}d}"
    return _respell(m.group(), body + next(c for c in _DIG if luhn_ok(body + c)))


#: Country calling codes of one and two digits, all others have three; and the length of national numbers where a country has one (fixed values).
ONE_DIGIT = "1 7".split()
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
NATIONAL = {"1": 10, "7": 10, "27": 9, "30": 10, "31": 9, "33": 9, "34": 9, "41": 9, "45": 8, "47": 8, "48": 9, "52": 10, "61": 9, "65": 8, "90": 10, "91": 10}


def _subscriber(d: str, country: str, key: bytes) -> str:
    """Another national number of the country: a valid one of the North American plan for a valid one, a leading zero only for a leading zero."""
    tweak = f"phone{country}-{len(d)}"
    plan = re.fullmatch(r"([2-9])(\d\d)([2-9])(\d\d)(\d{4})", d) if country == "1" else None
    short = lambda x: x[1] == x[2] == "1"  # noqa: E731  service codes such as 911
    if plan and not short(d[:3]) and not short(d[3:6]):
        codes = [i for i in range(200, 1000) if i % 100 != 11]
        n = (bisect_left(codes, int(d[:3])) * len(codes) + bisect_left(codes, int(d[3:6]))) * 10_000 + int(d[6:])
        n, line = divmod(permute(n, len(codes) ** 2 * 10_000, key, tweak), 10_000)
        return f"{codes[n // len(codes)]}{codes[n % len(codes)]}{line:04d}"

    def odd(n: int) -> bool:
        x = f"{n:0{len(d)}d}"
        valid = country == "1" and len(x) == 10 and x[0] >= "2" and x[3] >= "2" and not short(x[:3]) and not short(x[3:6])
        return not valid and (x[0] == "0") == (d[0] == "0")

    n = permute(int(d), 10 ** len(d), key, tweak)
    while not odd(n):  # cycle walking stays among numbers of this kind
        n = permute(n, 10 ** len(d), key, tweak)
    return f"{n:0{len(d)}d}"


def _phone(m: re.Match, key: bytes) -> tuple[int, str] | None:
    """Length of the phone number at the match and its pseudonym.

    The country code is read from the digits whatever separates them, a trunk zero
    in brackets is no part of the number, and ten digits without a country code
    are of the North American plan, so one number has one pseudonym in all its
    spellings.
    """
    t = m.group()
    at = [i for i, c in enumerate(t) if c.isdigit()]
    if t[0] == "+" or t.startswith("00"):
        at = at[2 * (t[0] == "0") :]
        d = "".join(t[i] for i in at)
        country = d[:1] if d[:1] in ONE_DIGIT else d[:2] if d[:2] in TWO_DIGITS else d[:3]
        at = at[len(country) :]
        if at and t[at[0] - 1 : at[0] + 2] == "(0)":
            at = at[1:]
        want = NATIONAL.get(country)
        if want and len(at) > want and not t[at[want - 1] + 1].isdigit():  # digits after a blank belong to what follows
            at = at[:want]
        if not 5 <= len(at) <= 13 or len(country) + len(at) < 7:
            return None
    else:
        country = "1"
    new = list(t)
    for i, c in zip(at, _subscriber("".join(t[i] for i in at), country, key)):
        new[i] = c
    end = at[-1] + 1
    return end, "".join(new[:end])


def _ip(m: re.Match, key: bytes) -> str | None:
    o = [int(x) for x in m.group().split(".")]
    if max(o) > 255 or any(len(x) > 1 and x[0] == "0" for x in m.group().split(".")):
        return None
    n = permute(int.from_bytes(bytes(o), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _ip6(m: re.Match, key: bytes) -> str | None:
    """An address of version 6 in its canonical spelling; its spellings have one pseudonym."""
    t = m.group()
    groups = [g for g in t.split(":") if g]
    try:
        n = int(ipaddress.IPv6Address(t))
    except ValueError:
        return None
    # Times, ratios and scope operators of programs are no addresses.
    if len(groups) < 3 and not (len(groups) == 2 and len(groups[0]) >= 3 and re.search(r"\d", groups[0])):
        return None
    return str(ipaddress.IPv6Address(permute(n, 1 << 128, key, "ip6")))


@lru_cache(1)
def _days() -> tuple[list[list[int]], list[int]]:
    """Days by kind, and the kind of each.

    Two facts show in some spellings and stay: whether the day can be read as a
    month, and whether day or month has one digit.  So a date has one pseudonym in
    all spellings, and each is read as it was written.
    """
    lists: list[list[int]] = [[], [], [], []]
    kinds = []
    for i in range(_DAYS):
        d = datetime.date.fromordinal(_EPOCH + i)
        kinds.append(2 * (d.day > 12) + (d.day < 10 or d.month < 10))
        lists[kinds[-1]].append(i)
    return lists, kinds


def _date(m: re.Match, key: bytes) -> str | None:
    """Year first, day first with dots; with slashes month first where that is a date, else day first."""
    t = m.group()
    sep = next(c for c in t if not c.isdigit())
    part = t.split(sep)
    first = int(part[0]) <= 12 or sep != "/"
    order = (0, 1, 2) if len(part[0]) == 4 else (2, 0, 1) if sep == "/" and first else (2, 1, 0)
    try:
        day = datetime.date(*(int(part[i]) for i in order)).toordinal() - _EPOCH
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    lists, kinds = _days()
    same = lists[kinds[day]]
    new = datetime.date.fromordinal(same[permute(bisect_left(same, day), len(same), key, f"date{kinds[day]}")] + _EPOCH)
    wide = 1 if any(len(p) == 1 for p in part) else 2
    for i, v in zip(order, (new.year, new.month, new.day)):
        part[i] = f"{v:0{4 if i == order[0] else wide}d}"
    return sep.join(part)


def _ssn(m: re.Match, key: bytes) -> str | None:
    a, g, s = map(int, m.group().split("-"))
    if a in (0, 666) or a >= 900 or g == 0 or s == 0:
        return None
    n = permute(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, key, "ssn")
    n, s = divmod(n, 9999)
    a, g = divmod(n, 99)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


#: Characters of an account number by country (fixed values).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def _iban(m: re.Match, key: bytes) -> tuple[int, str] | None:
    """Length of the account number at the match, which its country tells, and its pseudonym."""
    t = m.group()
    at = [i for i, c in enumerate(t) if c.isalnum()]
    want = IBAN_LENGTH.get(t[:2].upper())
    if not want or len(at) < want or t[at[want - 1] + 1 : at[want - 1] + 2].isalnum():
        return None
    at = at[:want]
    whole = "".join(t[i] for i in at)
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if number(whole[4:] + whole[:4]) % 97 != 1:
        return None
    country = whole[:2].upper()
    body = by_class(whole[4:].upper(), key, f"iban{country}")
    other = iter(country + f"{98 - number(body + country + '00') % 97:02d}" + body)
    end = at[-1] + 1
    return end, "".join((next(other).lower() if c.islower() else next(other)) if c.isalnum() else c for c in t[:end])


def _email(m: re.Match, key: bytes) -> str | None:
    """Case does not tell addresses apart: the lower-case address is moved, its capitals stay where they were."""
    local, _, host = m.group().lower().rpartition("@")
    name, _, top = host.rpartition(".")
    new = f"{by_class(local, key, 'local')}@{by_class(name, key, 'host')}.{top}"
    return "".join(c.upper() if old.isupper() else c for c, old in zip(new, m.group()))


_E = r"(?<![A-Za-z0-9])"
_RULES = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"), "@", _email),
    ("iban", re.compile(_E + r"[A-Za-z]{2}\d{2}(?:[ -]?[A-Za-z0-9]){11,30}"), "", _iban),
    ("ip", re.compile(r"(?<![A-Za-z0-9:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![A-Za-z0-9:]|\.\d)"), ":", _ip6),
    ("card", re.compile(_E + r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![A-Za-z0-9])"), "", _card),
    ("ssn", re.compile(_E + r"\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-])"), "-", _ssn),
    ("date", re.compile(_E + r"(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![A-Za-z0-9])"), "", _date),
    ("ip", re.compile(r"(?<![A-Za-z0-9.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![A-Za-z0-9]|\.\d)"), ".", _ip),
    ("phone", re.compile(r"(?<![A-Za-z0-9])(?:(?:\+ ?|00[ .-]?)[1-9](?:[ ./-]?\(?\d\)?){6,15}(?![A-Za-z0-9])|(?:\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![A-Za-z0-9]))"), "", _phone),
)


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, dict[str, int]]:
    """The text with pseudonyms, and the number of values by kind."""
    found = dict.fromkeys(KINDS, 0)
    if not text or not re.search(r"[0-9@]", text):
        return text, found
    spans: list[tuple[int, int, str, str]] = []  # in order of place, apart
    for kind, rule, needs, make in _RULES:
        if needs and needs not in text:
            continue
        fresh, starts = [], [s[0] for s in spans]
        at, m = 0, rule.search(text)
        while m:
            k, at, got = bisect_left(starts, m.end()), m.start() + 1, None  # of the earlier rules' spans only the last one that begins before may overlap
            if not k or spans[k - 1][1] <= m.start():
                got = make(m, key)
            if got is not None:
                length, new = got if isinstance(got, tuple) else (len(m.group()), got)
                at = m.start() + length
                if not k or spans[k - 1][0] >= at or spans[k - 1][1] <= m.start():
                    fresh.append((m.start(), at, new, kind))
            m = rule.search(text, at)
        if fresh:
            spans = sorted(spans + fresh)
    out, at = [], 0
    for a, b, new, kind in spans:
        out += [text[at:a], new]
        at = b
        found[kind] += 1
    return "".join(out) + text[at:], found


def restore(text: str | None, key: bytes) -> str | None:
    """The text that ``pseudonymise`` under the same key was given: pseudonyms are values of their formats, so they are found again and moved back."""
    return pseudonymise(text, Undo(key))[0]


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """``row``, the columns of ``docs`` with pseudonyms in ``text``, and a count ``n_<kind>`` for each kind.

    Null texts stay null and empty ones empty; repeated rows get the same
    pseudonyms; other columns pass through in ``row`` whatever their names.
    """
    small_batches(docs.sparkSession)

    def one(batch: pa.RecordBatch) -> dict:
        texts, counts = [], {k: [] for k in KINDS}
        for t in batch.column("text").to_pylist():
            new, found = pseudonymise(t, key)
            texts.append(new)
            for k, v in found.items():
                counts[k].append(v)
        return {"new": texts, **{f"n_{k}": v for k, v in counts.items()}}

    out = annotate(docs, one, "new string, " + ", ".join(f"n_{k} int" for k in KINDS))
    return out.select(F.col("row").withField("text", F.col("new")).alias("row"), *[f"n_{k}" for k in KINDS])


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text`` with pseudonyms and ``n_<kind>`` counts, one row per document."""
    return replace(docs.select("doc_id", "text"), key).select("row.*", *[f"n_{k}" for k in KINDS])
