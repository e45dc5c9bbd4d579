"""Text rules: trimming, look-alike letters, natural order, marker text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a full Unicode trim removes.
UNICODE_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Look-alike letters between the Latin and Cyrillic scripts.
PART_LETTERS_CYRILLIC = "АВ"
PART_LETTERS_LATIN = "AB"
MARKER_LETTERS_CYRILLIC = "АБВ"
MARKER_LETTERS_LATIN = "ABB"
ANSWER_LATIN = "ABCEHKMOPTXYF"
ANSWER_CYRILLIC = "АВСЕНКМОРТХУГ"
PART_WORD = "ЧАСТЬ"
UNKNOWN_ANSWER = "неизвестен"

# Places for the length of a run of digits, which goes ahead of it so that text order is numeric order.
LENGTH_PLACES = 10


def unicode_trim(c: Column) -> Column:
    """Trim every Unicode space, where ``F.trim`` removes U+0020 only."""
    return F.btrim(c, F.lit(UNICODE_SPACES))


def whole_number(c: Column, kind: str = "long") -> Column:
    """The integer a text spells, null for any other text.

    The pattern is tried first: a failed cast builds an exception per row, which costs more than all
    the rest of a scoring query.
    """
    return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast(kind))


def integer_text(c: Column) -> Column:
    """The integer a text spells, of any length, in one spelling (no plus, no leading zeros); null for any other text.

    Equal integers have equal texts, where :func:`whole_number` is null beyond what its kind can hold.
    """
    digits = F.ltrim(c, F.lit("+-0"))
    sign = F.when(c.startswith("-"), "-").otherwise("")
    return F.when(c.rlike(r"^[+-]?\d+\z"), F.when(digits == "", "0").otherwise(F.concat(sign, digits)))


def worked_out(value: Column) -> Column:
    """*value* as a row's only element, to be selected: what later filters and columns read of it is not worked out anew for each.

    A filter above a plain column is moved below it with the column's expression in every place that names it.
    """
    return F.explode(F.array(value))


def natural_sort_key(stem: Column) -> Column:
    """A string whose plain order compares digit runs as numbers and the rest lower-cased.

    Runs are set apart by U+0001, which sorts below any letter, so ``p_2`` < ``p_10`` and a stem sorts
    ahead of its own extensions. A run counts as its length and digits, without leading zeros, so it may be of any length.
    """
    runs = F.regexp_extract_all(F.lower(stem), F.lit(r"(\d+|\D+)"))
    placed = F.transform(
        runs,
        lambda r: F.when(r.rlike(r"^\d"), F.concat(F.lit("\u0001"), _digit_count(r), _significant(r))).otherwise(r),
    )
    return F.array_join(placed, "\u0001")


def _significant(digits: Column) -> Column:
    return F.ltrim(digits, F.lit("0"))


def _digit_count(digits: Column) -> Column:
    return F.lpad(F.length(_significant(digits)).cast("string"), LENGTH_PLACES, "0")


def natural_order(name: Column) -> list[Column]:
    """Columns ordering all-digit names numerically, of any length, and every other name at the place of 2**31."""
    number = F.when(name.rlike(r"^\d+\z"), name).otherwise(F.lit(str(2**31)))
    return [_digit_count(number), _significant(number), F.when(~name.rlike(r"^\d+\z"), name)]


def question_key(raw: Column) -> Column:
    """``struct(part, number, digits)`` of a typed key such as `` а12 ``, null when it is no key.

    digits is the number's text, of any length; number is null where a long cannot hold it.
    """
    folded = F.translate(F.upper(unicode_trim(raw)), PART_LETTERS_CYRILLIC, PART_LETTERS_LATIN)
    digits = F.nullif(F.regexp_extract(folded, r"^[AB]0*(\d+)\z", 1), F.lit(""))
    return F.when(
        digits.isNotNull(),
        F.struct(F.substring(folded, 1, 1).alias("part"), digits.try_cast("long").alias("number"), digits.alias("digits")),
    )


def question_key_text(part: Column, number: Column) -> Column:
    return F.concat(part, number.cast("string"))


def answer_script(answer: Column) -> Column:
    """Latin capitals typed for Cyrillic ones, put back into Cyrillic."""
    return F.translate(answer, ANSWER_LATIN, ANSWER_CYRILLIC)


def part_letter(marker_text: Column) -> Column:
    """The part a marker's text names: A if an A is in it, else B, else null.

    The part word is dropped first because its own second letter folds to A.
    """
    bare = F.replace(F.upper(marker_text), F.lit(PART_WORD), F.lit(""))
    folded = F.translate(bare, MARKER_LETTERS_CYRILLIC, MARKER_LETTERS_LATIN)
    return F.when(folded.contains("A"), "A").when(folded.contains("B"), "B")


def display_answer(answer: Column) -> Column:
    """An answer key for display; a question without one says so."""
    return F.coalesce(answer, F.lit(UNKNOWN_ANSWER))
