"""Text as Columns: normalising, recoding, folding for search, display."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean "no value", exact and case-sensitive.
NULLISH = ("", "-", "N/A", "n/a", "NA", "NULL", "null", "Null", "NONE", "None", "none", "NaN", "nan")



def _bases() -> tuple[str, str]:
    """Characters that canonical decomposition takes to a base character and marks, and those bases."""
    pairs = []
    for code in range(0xC0, 0x10000):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code) and not 0xD800 <= code < 0xE000:
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, UNACCENTED = _bases()


def squeeze(c: Column) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise_text(c: Column) -> Column:
    """Squeezed text, NULL for a spelling of no value. Case and accents stay as they are; a whole number has no decimals, a boolean is no text."""
    kind, number = F.typeof(c), c.try_cast("double")
    whole = kind.isin("double", "float") & (number == F.floor(number)) & (F.abs(number) < 1e15)
    t = squeeze(F.when(kind != "boolean", F.when(whole, number.try_cast("long").cast("string")).otherwise(c.cast("string"))))
    return F.when(~t.isin(*NULLISH), t)


def blank_to_null(c: Column) -> Column:
    """NULL for an empty string and nothing else."""
    return F.nullif(c, F.lit(""))


def whitespace_changed(c: Column) -> Column:
    return c.isNotNull() & (squeeze(c) != c)


def nullish(c: Column) -> Column:
    """A value was there and means none."""
    return c.isNotNull() & normalise_text(c).isNull()


def recode(c: Column, mapping: dict[str, str]) -> Column:
    """The mapped value; NULL for a value outside the vocabulary."""
    return reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), list(mapping.items())[1:], F.when(c == next(iter(mapping)), next(iter(mapping.values()))))


def first_text(*cs: Column) -> Column:
    return F.coalesce(*(normalise_text(c) for c in cs))


def joined(left: Column, word: str, right: Column) -> Column:
    """``left word right``, or the one that is there."""
    return F.when(left.isNotNull() & right.isNotNull(), F.concat(left, F.lit(f" {word} "), right)).otherwise(F.coalesce(left, right))


def in_name_order(c: Column) -> Column:
    """A sort key in the order of names: letters before their accents and capitals (a < A < b < e < É), marks and digits before letters."""
    return F.collate(c, "UNICODE")


def name_set(c: Column) -> Column:
    """A comma list as a sorted set of trimmed lower-case names."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def _hangul_letters(c: Column) -> Column:
    """Hangul syllables as the letters that they are composed of, by their places in Unicode."""
    leads, vowels, tails = ("".join(chr(first + i) for i in range(n)) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))
    letter = lambda letters, i: F.substring(F.lit(letters), i + 1, F.lit(1))

    def parts(ch: Column) -> Column:
        s = F.ascii(ch) - 0xAC00
        tail = F.when(s % 28 > 0, letter(tails, s % 28 - 1)).otherwise("")
        return F.when(s.between(0, 11171), F.concat(letter(leads, F.floor(s / 588).cast("int")), letter(vowels, F.floor(s % 588 / 28).cast("int")), tail)).otherwise(ch)

    return F.when(c.rlike("[가-힣]"), F.array_join(F.transform(F.split(c, ""), parts), "")).otherwise(c)


def search_fold(c: Column) -> Column:
    """Without accents, apostrophes, marks and case, Hangul by letters: what search compares."""
    t = F.regexp_replace(F.translate(_hangul_letters(c), ACCENTED, UNACCENTED), r"['‘’\p{M}]", "")
    return squeeze(F.lower(F.regexp_replace(t, r"[\p{P}\p{S}]+", " ")))


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """``1,234 places``."""
    return F.concat(F.format_number(n, 0), F.when(n == 1, f" {one}").otherwise(f" {many or one + 's'}"))


def day_text(d: Column) -> Column:
    return F.date_format(d, "MMM d, yyyy")


def date_range(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(day_text(a), F.lit(" – "), day_text(b))).otherwise(F.coalesce(day_text(a), day_text(b)))


def licence_period(issued: Column, expires: Column) -> Column:
    both = F.concat(F.lit("Issued "), day_text(issued), F.lit(" · expires "), day_text(expires))
    return (
        F.when(issued.isNotNull() & expires.isNotNull(), both)
        .when(issued.isNotNull(), F.concat(F.lit("Issued "), day_text(issued)))
        .when(expires.isNotNull(), F.concat(F.lit("Expires "), day_text(expires)))
        .otherwise("Licence dates not published")
    )


def ordinal(n: Column) -> Column:
    last, teens = n % 10, (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(teens, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def relative_age(seconds: Column) -> Column:
    """``3 days ago`` for an age in seconds; weeks until 30 days, then months of 30 days."""
    minute, hour, day = 60, 3600, 86400

    def ago(unit: int, one: str) -> Column:
        n = F.floor(seconds / unit).cast("long")
        return F.concat(n.cast("string"), F.when(n == 1, f" {one} ago").otherwise(f" {one}s ago"))

    return (
        F.when(seconds.isNull(), "an unknown time ago").when(seconds < 0, "moments from now").when(seconds < minute, "just now")
        .when(seconds < hour, ago(minute, "minute")).when(seconds < day, ago(hour, "hour")).when(seconds < 7 * day, ago(day, "day"))
        .when(seconds < 30 * day, ago(7 * day, "week")).otherwise(ago(30 * day, "month"))
    )
