"""Format-preserving pseudonyms for personal data: validated values are permuted within their format under a key."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperloom.llm.common import slices, travels

travels(__name__)

FEISTEL_ROUNDS = 10
KINDS = ("email", "iban", "secret", "card", "date", "ssn", "ip", "phone")
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY
SSN_AREAS = [a for a in range(1, 900) if a != 666]

#: What may be personal; each find is then validated by its kind.
FOUND = re.compile(
    r"""
    (?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
  | (?P<secret>(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])
      |(?i:password|passwd|pwd|secret|token|api_?key|access_?key)["']?[ ]?[=:][ ]?["']?[A-Za-z0-9_+/-]{8,}))
  | (?P<card>(?<![A-Za-z0-9.])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])(?:[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{6}(?P=gap)[0-9]{5}))(?![A-Za-z0-9]))
  | (?P<date>(?<![A-Za-z0-9./-])(?:[0-9]{4}(?P<by1>[-/.])[0-9]{1,2}(?P=by1)[0-9]{1,2}|[0-9]{1,2}(?P<by2>[-/.])[0-9]{1,2}(?P=by2)[0-9]{4})(?![A-Za-z0-9]|[./-][0-9]))
  | (?P<ssn>(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9]))
  | (?P<ip>(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9]))
  | (?P<phone>(?<![A-Za-z0-9])(?:\+1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|(?<=\+1)[0-9]{3}[ .-]?|(?<=\+1[ .-])[0-9]{3}[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-]?[0-9]{4}(?![A-Za-z0-9])
      |(?<![A-Za-z0-9])\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![A-Za-z0-9]))
    """,
    re.VERBOSE,
)
#: Every find holds one of these.
ANCHOR = re.compile(r"[0-9]+|[@=:]")
SPACE = re.compile(r"\s|$")
#: How far a find may begin before, and go on after, the run of non-spaces around an anchor.
BEFORE, AFTER = 24, 24


def feistel(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse: a Feistel network over two halves a and b with a * b just above
    size, walked on until it is back below it."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)

    def shift(i: int, half: int) -> int:
        text = b"%d|%s|%d|%d|%d|%s" % (len(key), key, i, half, size, tweak)
        return int.from_bytes(hashlib.shake_256(text).digest(16 + size.bit_length() // 16))

    while True:
        left, right = divmod(value, b)
        for i in reversed(range(FEISTEL_ROUNDS)) if back else range(FEISTEL_ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * shift(i, left)) % b
            else:
                left = (left + sign * shift(i, right)) % a
        value = left * b + right
        if value < size:
            return value


def permute_until(value: int, size: int, fits: Callable[[int], bool], key: bytes, tweak: bytes, back: bool) -> int:
    """The same over those values below size that fit, of which *value* must be one."""
    while True:
        value = feistel(value, size, key, tweak, back)
        if fits(value):
            return value


def permute_text(text: str, key: bytes, tweak: bytes, back: bool = False, hexadecimal: bool = False) -> str:
    """Each ASCII letter and digit replaced by one of its kind, all of them together as one number; the rest stays."""
    sets = [HEX] if hexadecimal else [DIGITS, LOWER, UPPER]
    kinds = [next((s for s in sets if c in s), None) for c in text]
    value, size = 0, 1
    for c, s in zip(text, kinds, strict=True):
        if s:
            value, size = value * len(s) + s.index(c), size * len(s)
    shape = "".join("-" if s is None else "d" if s is DIGITS else "x" if s is HEX else "l" if s is LOWER else "u" for s in kinds)
    value = feistel(value, size, key, tweak + shape.encode(), back)
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if kinds[i]:
            value, k = divmod(value, len(kinds[i]))
            out[i] = kinds[i][k]
    return "".join(out)


def refill(shape: str, digits: str) -> str:
    """The digits put into the places that *shape* has for digits."""
    own = iter(digits)
    return "".join(next(own) if c in DIGITS else c for c in shape)


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10: 0 for a valid number."""
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def card(found: str, key: bytes, back: bool) -> str | None:
    digits = "".join(c for c in found if c in DIGITS)
    if luhn(digits) or len(set(digits)) == 1:
        return None
    n = len(digits) - 2
    middle = feistel(int(digits[1:-1]), 10**n, key, b"card%s%d" % (digits[0].encode(), n), back)
    body = f"{digits[0]}{middle:0{n}d}"
    return refill(found, body + str(-luhn(body + "0") % 10))


def iban(found: str, key: bytes, back: bool) -> str | None:
    plain = found.replace(" ", "")
    if not 15 <= len(plain) <= 34 or mod97(plain) != 1:
        return None
    body = permute_text(plain[4:], key, b"iban" + plain[:2].encode(), back)
    own = iter(f"{plain[:2]}{98 - mod97(plain[:2] + '00' + body):02d}{body}")
    return "".join(c if c == " " else next(own) for c in found)


def secret(found: str, key: bytes, back: bool) -> str | None:
    head, value = re.fullmatch(r"(AKIA|.*[=:]\s?[\"']?)(.*)", found, re.DOTALL).groups()
    if head != "AKIA" and not any(c in DIGITS for c in value):
        return None  # prose: "token: whatever"
    hexadecimal = all(c in HEX for c in value)
    pieces = [value[i : i + 64] for i in range(0, len(value), 64)]
    return head + "".join(permute_text(p, key, b"secret%d" % i, back, hexadecimal) for i, p in enumerate(pieces))


def email(found: str, key: bytes, back: bool) -> str | None:
    local, _, domain = found.partition("@")
    host, dot, top = domain.rpartition(".")
    if not top.isalpha() or len(top) < 2:
        return None
    moved = permute_text(f"{local}@{host}", key, b"email" + top.lower().encode(), back)
    return moved + dot + top


def date(found: str, key: bytes, back: bool) -> str | None:
    parts = re.split(r"[-/.]", found)
    year_first = len(parts[0]) == 4
    month_first = not year_first and int(parts[1]) > 12  # month/day/year only where it must be
    order = (0, 1, 2) if year_first else (2, 0, 1) if month_first else (2, 1, 0)
    try:
        day = datetime.date(*(int(parts[i]) for i in order)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None

    def fits(value: int) -> bool:  # the format must read the same way afterwards
        return not month_first or datetime.date.fromordinal(FIRST_DAY + value).day > 12

    tweak = b"date" + (b"us" if month_first else b"")
    moved = datetime.date.fromordinal(FIRST_DAY + permute_until(day, DAYS, fits, key, tweak, back))
    values = (moved.year, moved.month, moved.day)
    padded = any(len(p) == 2 and p[0] == "0" for p in parts) or all(len(p) != 1 for p in parts)
    texts = [str(v).zfill(2) if padded else str(v) for v in values]
    placed = [texts[order.index(i)] for i in range(3)]
    separator = next(c for c in found if c not in DIGITS)
    return separator.join(placed)


def ssn(found: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, found.split("-"))
    if area == 0 or area == 666 or area >= 900 or group == 0 or serial == 0:
        return None
    value = (SSN_AREAS.index(area) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(feistel(value, len(SSN_AREAS) * 99 * 9999, key, b"ssn", back), 9999)
    area, group = divmod(rest, 99)
    return f"{SSN_AREAS[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def ip(found: str, key: bytes, back: bool) -> str | None:
    octets = found.split(".")
    if any(int(o) > 255 or (o[0] == "0" and o != "0") for o in octets):
        return None
    value = int.from_bytes(bytes(map(int, octets)))
    moved = feistel(value, 1 << 32, key, b"ip", back)
    return ".".join(map(str, moved.to_bytes(4)))


def phone(found: str, key: bytes, back: bool) -> str | None:
    digits = "".join(c for c in found if c in DIGITS)
    if found.startswith("+") and digits[0] != "1":
        if not 8 <= len(digits) <= 15:
            return None
        n = len(digits) - 2
        return refill(found, f"{digits[:2]}{feistel(int(digits[2:]), 10**n, key, b'phone' + digits[:2].encode(), back):0{n}d}")
    prefix, national = digits[:-10], digits[-10:]
    if national[0] in "01":
        return None

    def fits(value: int) -> bool:
        return value >= 2 * 10**9

    return refill(found, f"{prefix}{permute_until(int(national), 10**10, fits, key, b'phone', back):010d}")


RULES = {"email": email, "iban": iban, "secret": secret, "card": card, "date": date, "ssn": ssn, "ip": ip, "phone": phone}


def regions(text: str) -> Iterator[tuple[int, int]]:
    """The stretches of a text that can hold a find: around its anchors, in order and apart. Each part is looked at once."""
    start = end = -1
    floor = 0
    for anchor in ANCHOR.finditer(text):
        if anchor.start() < end:
            continue
        head = max(text.rfind(c, floor, anchor.start()) for c in " \n\t") + 1
        head, tail = max(head or floor, floor), min(len(text), SPACE.search(text, anchor.end()).start() + AFTER)
        if start >= 0 and head - BEFORE > end:
            yield start, end
            start = -1
        if start < 0:
            start = max(floor, head - BEFORE)
        end = floor = SPACE.search(text, tail).start()
    if start >= 0:
        yield start, end


def pseudonyms(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its personal values permuted, and how many of each kind there were. *back* undoes it."""
    counts: dict[str, int] = {}
    out, done = [], 0
    for start, end in regions(text):
        while match := FOUND.search(text, start, end):
            kind = match.lastgroup
            moved = RULES[kind](match.group(), key, back)
            start = match.end()
            if moved is None:
                start = match.start() + 1  # another find may begin inside
                continue
            counts[kind] = counts.get(kind, 0) + 1
            out += [text[done : match.start()], moved]
            done = match.end()
    if not counts:
        return text, counts
    return "".join(out) + text[done:], counts


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with the text pseudonymised, n_<kind> for each of KINDS and n_values, over whole texts.

    Cards and IBANs keep their check digits right, dates stay dates, and equal values of a kind stay equal across documents and
    spellings. What does not validate stays. A null text stays null with counts of 0; repeated rows get the same answer. Columns of the
    names given here are replaced, all others passed on. Whoever has the key can undo it (pseudonyms(..., back=True)).
    """
    names = [f"n_{k}" for k in KINDS]
    rest = docs.drop(*names, "n_values")
    given = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            answers = [(None, {}) if t is None else pseudonyms(t, key) for t in batch.column(text_col).to_pylist()]
            columns = [
                pa.array([a[0] for a in answers], pa.string()) if name == text_col else column
                for name, column in zip(batch.schema.names, batch.columns, strict=True)
            ]
            counts = [pa.array([a[1].get(k, 0) for a in answers], pa.int64()) for k in KINDS]
            total = pa.array([sum(a[1].values()) for a in answers], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, *counts, total], [*given, *names, "n_values"])

    added = [T.StructField(n, T.LongType()) for n in [*names, "n_values"]]
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, *added]))


def op3(spark, sf_dir):
    """The key is a setting of the session; the registered query falls back on a published one."""
    key = spark.conf.get("spark.paperloom.pseudonymKey", "a key for tests only").encode()
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key)


QUERIES = {"op3_feistel_pseudonyms": op3}
SQL: dict[str, str] = {}
