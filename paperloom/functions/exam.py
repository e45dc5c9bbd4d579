"""Exam rules: options, exam types, subject names, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import integer_text, unicode_trim

# Fixed values of the corpus.
OPTIONS_PER_BOOK = 10
EXAM_TYPE_INTRO_YEAR = 2023
CE_MAX_OPTION = 5
EXAM_TYPES = ("CE", "CT")
PARTS = ("A", "B")
STATUSES = ("pending", "approved", "rejected")
ALTERNATIVE_SEPARATOR = "/"
PART_A_KEY_PATTERN = r"^[1-9][0-9]*\z"

# The names subjects are shown under.
SUBJECT_NAMES = {
    "biology": "Биология",
    "chemistry": "Химия",
    "physics": "Физика",
    "math": "Математика",
    "russian": "Русский язык",
    "history": "История",
    "social": "Обществознание",
}

# Month names as a date is written out.
MONTHS = (
    "января",
    "февраля",
    "марта",
    "апреля",
    "мая",
    "июня",
    "июля",
    "августа",
    "сентября",
    "октября",
    "ноября",
    "декабря",
)


def fold_option(raw: Column) -> Column:
    """1..10 for any option number: blocks of ten name the same ten options."""
    return F.pmod(raw - 1, F.lit(OPTIONS_PER_BOOK)) + 1


def option_of_text(marker_text: Column) -> Column:
    """The folded option number a marker's first digit run names, however long: its last digit, 0 standing for ten."""
    digits = F.try_element_at(F.regexp_extract_all(marker_text, F.lit(r"(\d+)")), F.lit(1))
    return fold_option(F.right(digits, F.lit(1)).try_cast("int")).cast("int")


def exam_type(year: Column, option: Column) -> Column:
    split = (year >= EXAM_TYPE_INTRO_YEAR) & (option <= CE_MAX_OPTION)
    return F.when(split, "CE").otherwise("CT")


def valid_exam_type(raw: Column) -> Column:
    """The exam type itself, null when the text names none."""
    return F.when(raw.isin(*EXAM_TYPES), raw)


def subject_name(subject: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SUBJECT_NAMES.items() for x in pair])
    capitalised = F.concat(F.upper(F.substring(subject, 1, 1)), F.lower(F.substring(subject, 2, 2**31 - 1)))
    return F.coalesce(F.try_element_at(known, F.lower(subject)), capitalised)


def accepted_spellings(key: Column) -> Column:
    """Every spelling a Part B key accepts. Worked out once per question, not once per reply."""
    parts = F.transform(F.split(key, ALTERNATIVE_SEPARATOR), unicode_trim)
    return F.filter(parts, lambda p: p != "")


def answer_matches(part: Column, key: Column, reply: Column, spellings: Column | None = None) -> Column:
    """Whether a reply is right under its part's rule; a missing key matches nothing.

    A Part A reply that is no integer is wrong here (see :func:`reply_reject_reason`).
    """
    said = unicode_trim(reply)
    spellings = accepted_spellings(key) if spellings is None else spellings
    by_number = integer_text(said) == integer_text(unicode_trim(key))
    return F.coalesce(F.when(part == "A", by_number).otherwise(F.array_contains(spellings, said)), F.lit(False))


def reply_reject_reason(part: Column, key: Column, reply: Column) -> Column:
    """Why a reply could not be judged: a keyed Part A question answered with no integer."""
    unreadable = integer_text(unicode_trim(reply)).isNull()
    return F.when((part == "A") & key.isNotNull() & unreadable, "not an integer")


def admitted_key(part: Column, raw: Column) -> Column:
    """``struct(answer, keyed, warning)``: the key to store for a typed answer.

    Absent or empty gives no key; a Part A text that is not all digits gives none and a warning.
    """
    present = raw.isNotNull() & (raw != "")
    unusable = present & (part == "A") & ~raw.rlike(r"^\d+\z")
    keyed = F.coalesce(present & ~unusable, F.lit(False))
    return F.struct(
        F.when(keyed, raw).alias("answer"),
        keyed.alias("keyed"),
        F.when(unusable, "part A answer is not a number").alias("warning"),
    )


def date_text(ts: Column, zone: str) -> Column:
    """A UTC timestamp written out in *zone*: day, month name, year and clock."""
    local = F.from_utc_timestamp(ts, zone)
    months = F.array(*[F.lit(m) for m in MONTHS])
    return F.format_string(
        "%d %s %d в %02d:%02d",
        F.dayofmonth(local),
        F.element_at(months, F.month(local)),
        F.year(local),
        F.hour(local),
        F.minute(local),
    )


def seeded_hash(seed: Column | str, *ids: Column) -> Column:
    """The md5 text draws are ordered by: the same in any engine, fixed by the seed."""
    first = F.lit(seed) if isinstance(seed, str) else seed
    return F.md5(F.concat_ws("|", first, *[i.cast("string") for i in ids]))


def seeded_number(seed: Column | str, *ids: Column) -> Column:
    """The first fifteen hex digits of :func:`seeded_hash` as a long: as many as one holds, so that ids made of it stay apart."""
    return F.conv(F.substring(seeded_hash(seed, *ids), 1, 15), 16, 10).cast("long")
