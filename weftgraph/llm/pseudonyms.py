"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A validated value is an index into the set of all valid values of its format; a
keyed Feistel network permutes that set.  Equal values therefore get equal
pseudonyms in every document, different values stay different, checksums hold
and the layout (separators, digit counts, date order) stays as it was.  A day has
one pseudonym in all date layouts, an e-mail address one in all letter cases; the
domain of an address and the bank letters of an IBAN name no person and stay.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.common import map_rows, read_table

ROUNDS = 10


def permute(x: int, size: int, key: bytes, tweak: str, backward: bool = False) -> int:
    """Keyed permutation of ``range(size)``: an alternating Feistel network, walked until it lands in range."""
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    width = (max(a, b).bit_length() + 7) // 8 + 8

    def f(r: int, half: int) -> int:
        data = f"{tweak}|{size}|{r}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=min(64, width)).digest(), "big")

    while True:
        left, right = divmod(x, b)
        for r in reversed(range(ROUNDS)) if backward else range(ROUNDS):
            sign = -1 if backward else 1
            if r % 2:
                right = (right + sign * f(r, left)) % b
            else:
                left = (left + sign * f(r, right)) % a
        x = left * b + right
        if x < size:
            return x


def _walk(x: int, size: int, key: bytes, tweak: str, ok: Callable[[int], bool]) -> int:
    """Permute within the subset of ``range(size)`` where ``ok`` holds."""
    while not ok(x := permute(x, size, key, tweak)):
        pass
    return x


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def luhn_digit(body: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def _digits(n: int, width: int) -> str:
    return f"{n:0{width}d}"


def _card(text: str, key: bytes) -> str | None:
    d = re.sub(r"[ -]", "", text)
    if not 13 <= len(d) <= 19 or len(set(d)) == 1 or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = d[0] + _digits(permute(int(d[1:-1]), 10 ** (len(d) - 2), key, f"card{d[0]}"), len(d) - 2)
    return _refill(text, body + luhn_digit(body))


def _phone(text: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", text)
    local = d[-10:]
    if len(d) == 11 and d[0] == "1" or len(d) == 10 and not text.startswith("+"):
        outside = lambda x: x // 10**9 < 2 or x // 10**6 % 10 < 2
        if outside(int(local)):  # no number of the plan: permuted among those that are none, never left in clear
            return _refill(text, d[:-10] + _digits(_walk(int(local), 10**10, key, "nanp-outside", outside), 10))
        index = ((int(local[0]) - 2) * 100 + int(local[1:3])) * 8 * 10**6 + (int(local[3]) - 2) * 10**6 + int(local[4:])
        area, line = divmod(permute(index, 800 * 8 * 10**6, key, "nanp"), 8 * 10**6)
        new = f"{area // 100 + 2}{area % 100:02d}{line // 10**6 + 2}{line % 10**6:06d}"
        return _refill(text, d[:-10] + new)
    if not text.startswith("+") or not 8 <= len(d) <= 15:
        return None
    return _refill(text, d[:2] + _digits(permute(int(d[2:]), 10 ** (len(d) - 2), key, f"phone{d[:2]}"), len(d) - 2))


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return None
    index = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(permute(index, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _address(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    o = [int(p) for p in parts]
    if max(o) > 255 or any(p != str(n) for p, n in zip(parts, o)):
        return None
    if not 1 <= o[0] <= 223:  # 0 and 224 to 255: permuted among themselves
        first = 0 if o[0] == 0 else o[0] - 223
        x = permute((first << 24) + (o[1] << 16) + (o[2] << 8) + o[3], 33 << 24, key, "ipv4-outside")
        return f"{(x >> 24) + 223 if x >> 24 else 0}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"
    x = permute(((o[0] - 1) << 24) + (o[1] << 16) + (o[2] << 8) + o[3], 223 << 24, key, "ipv4")
    return f"{(x >> 24) + 1}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"


def _iban(text: str, key: bytes) -> str | None:
    s = text.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(s) <= 34 or number(s[4:] + s[:4]) % 97 != 1:
        return None
    old = "".join(c for c in s[4:] if c.isdigit())
    body = _refill(s[4:], _digits(permute(int(old), 10 ** len(old), key, f"iban{s[:2]}{len(old)}"), len(old))) if old else s[4:]
    new = s[:2] + f"{98 - number(body + s[:2] + '00') % 97:02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(text: str, key: bytes) -> str | None:
    """A day of the same class: as many digits of month and day, and a day of month that may be a month or not.

    Dots mean day, month, year; other marks month, day, year; the other order is taken where only it is a date.
    Within a class the widths and the order that a layout is read in stay, so equal days have equal pseudonyms in all layouts.
    """
    mark = re.search(r"\D", text).group()
    fields = text.split(mark)
    a, b, c = map(int, fields)
    orders = ("ymd",) if len(fields[0]) == 4 else ("dmy", "mdy") if mark == "." else ("mdy", "dmy")
    for order in orders:
        try:
            day = datetime.date(a, b, c) if order == "ymd" else datetime.date(c, a, b) if order == "mdy" else datetime.date(c, b, a)
        except ValueError:
            continue
        if not _FIRST <= day.toordinal() <= _LAST:
            return None
        kind = lambda x: (x.month > 9, x.day > 9, x.day > 12)
        own = kind(day)
        x = _walk(day.toordinal() - _FIRST, _LAST - _FIRST + 1, key, "date", lambda x: kind(datetime.date.fromordinal(_FIRST + x)) == own)
        new = datetime.date.fromordinal(_FIRST + x)
        parts = {"y": new.year, "m": new.month, "d": new.day}
        return mark.join(_digits(parts[k], len(f)) for k, f in zip(order, fields))
    return None


_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "0123456789")


def _email(text: str, key: bytes) -> str | None:
    """The local part permuted within its shape of letters and digits, its case put back; the domain stays."""
    local, _, domain = text.rpartition("@")
    low = local.lower()
    kinds = [next((a for a in _ALPHABETS if c in a), None) for c in low]
    index, size = 0, 1
    for c, a in zip(low, kinds):
        if a:
            index, size = index * len(a) + a.index(c), size * len(a)
    shape = "".join("x" if a is None else str(_ALPHABETS.index(a)) for a in kinds)
    index, out = permute(index, size, key, f"mail{shape}{domain.lower()}"), []
    for c, a in zip(reversed(local), reversed(kinds)):
        if a:
            index, k = divmod(index, len(a))
            c = a[k].upper() if c.isupper() else a[k]
        out.append(c)
    return "".join(reversed(out)) + "@" + domain


#: Kinds in order of precedence: pattern and pseudonym (None if the value is not valid).
KINDS: list[tuple[str, re.Pattern, Callable[[str, bytes], str | None]]] = [
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.ASCII), _email),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"), _card),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), _ssn),
    ("phone", re.compile(r"(?<![0-9+])(?:\+1[ .-]?|1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,5}\)?){2,5}(?![0-9])"), _phone),
    ("ipv4", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"), _address),
    ("date", re.compile(r"(?<![0-9/.-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[/.-][0-9])"), _date),
]
_ANY = re.compile(r"[0-9]|@")


#: Shortest values, without separators, of the kinds whose pattern may run on into what follows a value.
_SHORTEST = {"card": 13, "iban": 15}


def _ends(kind: str, m: re.Match) -> Iterator[int]:
    """The end of a match, then of each shorter prefix that ends before a separator."""
    yield m.end()
    if kind in _SHORTEST:
        value = m.group()
        for k in range(len(value) - 1, 0, -1):
            if value[k] in " -" and len(re.sub(r"[ -]", "", value[:k])) >= _SHORTEST[kind]:
                yield m.start() + k


def pseudonymize(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and ``(kind, start, end)`` of the values replaced (in the given text)."""
    if not _ANY.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []  # apart from each other, in order

    def free(a: int, b: int) -> bool:
        k = bisect.bisect_left(found, (a,))
        return (k == len(found) or b <= found[k][0]) and (k == 0 or found[k - 1][1] <= a)

    for kind, pattern, make in KINDS:
        at = 0
        while m := pattern.search(text, at):
            at = m.start() + 1 if kind in _SHORTEST else m.end()  # a value may start within a match that is none
            for end in _ends(kind, m):
                if free(m.start(), end) and (new := make(text[m.start() : end], key)) is not None:
                    bisect.insort(found, (m.start(), end, kind, new))
                    at = end  # what a shorter value leaves is searched again
                    break
    parts, done = [], 0
    for a, b, _, new in found:
        parts += [text[done:a], new]
        done = b
    return "".join([*parts, text[done:]]), [(kind, a, b) for a, b, kind, _ in found]


def protect(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``text`` with pseudonyms, ``n_replaced``, ``spans`` (kind:start:end, comma-joined).

    A null text stays null with nothing replaced; null ids and repeated rows are
    kept; other columns are not read; an empty table gives no rows.  ``key`` has up
    to 64 bytes; the same key links equal values over all runs.
    """

    def make():
        def work(cols):
            done = [pseudonymize(t, key) if t is not None else (None, []) for t in cols[1]]
            return [cols[0], [t for t, _ in done], [len(s) for _, s in done], [",".join(f"{k}:{a}:{b}" for k, a, b in s) for _, s in done]]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, text string, n_replaced long, spans string", make)


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key here is for the query only; a deployment passes its own secret."""
    return protect(read_table(spark, sf_dir, "documents"), b"weftgraph query key")
