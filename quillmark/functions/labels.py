"""Question labels as column expressions: tokens, parts, canonical key, roman numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings before a question's number, and the form of a roman numeral.
NOISE = r"^(questions?|ques|qn|q|ans(wer)?)\s*[.:)-]?\s*"
ROMAN = r"^m*(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
#: A run of letters that is a roman numeral of two letters or more.
ROMAN_RUN = "(?=[ivxlcdm]{2})" + ROMAN[1:-1] + "(?![a-z])"
ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def trimmed(col: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bare_label(col: Column) -> Column:
    """Lower case, without white space around it and without one leading word such as 'Question'."""
    return F.regexp_replace(F.lower(trimmed(col)), NOISE, "")


def is_roman(col: Column) -> Column:
    low = F.lower(col)
    return (F.length(low) > 0) & low.rlike(ROMAN)


def roman_to_int(col: Column) -> Column:
    """Value of a roman numeral: a letter before a larger one counts negative. Null stays null."""
    chars = F.filter(F.split(F.lower(col), ""), lambda c: c != "")
    value = lambda c: F.coalesce(F.element_at(F.create_map(*(x for k, v in ROMAN_VALUES.items() for x in (F.lit(k), F.lit(v)))), c), F.lit(0))
    values = F.transform(chars, value)
    following = F.concat(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.array(F.lit(0)))
    signed = F.zip_with(values, following, lambda a, b: F.when(a < b, -a).otherwise(a))
    return F.aggregate(signed, F.lit(0), lambda acc, x: acc + x)


def slug(col: Column) -> Column:
    """Letters and digits only; 'unlabelled' if there are none."""
    s = F.regexp_replace(F.lower(col), "[^a-z0-9]+", "")
    return F.when(F.length(s) > 0, s).otherwise("unlabelled")


def normalized_label(major: Column, minor: Column, roman: Column, raw: Column) -> Column:
    parts = F.concat_ws("-", F.when(major > 0, major.cast("string")), minor, roman)
    return F.when((major == 0) & minor.isNull() & roman.isNull(), slug(raw)).otherwise(parts)


def parse_label(col: Column) -> Column:
    """struct(major, minor, roman, normalized, parent, is_sub, is_orphan); a null label gives null.

    The first number is the major one. After it a single letter is the minor part (even i), a longer roman numeral
    the roman part, other letters a minor part. A lone letter or numeral without a number is an orphan sub-part.
    """
    found = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    def from_bare(bare: Column) -> Column:
        after = F.regexp_replace(bare, "^[^0-9]*[0-9]*", "")  # nothing if there is no number
        numbered = bare.rlike("[0-9]")
        lone = found(bare, "^[^a-z0-9]*([a-z]+)[^a-z0-9]*$")
        parts = F.struct(
            F.when(numbered, F.coalesce(F.regexp_extract(bare, "([0-9]+)", 1).try_cast("int"), F.lit(0))).otherwise(0).alias("major"),
            F.when(numbered, found(after, f"(?<![a-z])([a-z](?![a-z])|(?!{ROMAN_RUN})[a-z]{{2,}})")).otherwise(F.when(F.length(lone) == 1, lone)).alias("minor"),
            F.when(numbered, found(after, f"(?<![a-z])({ROMAN_RUN})")).otherwise(F.when((F.length(lone) > 1) & is_roman(lone), lone)).alias("roman"),
            (~numbered).alias("unnumbered"),
        )
        return let(parts, from_parts)

    def from_parts(p: Column) -> Column:
        sub = p["minor"].isNotNull() | p["roman"].isNotNull()
        return F.struct(
            p["major"].alias("major"),
            p["minor"].alias("minor"),
            p["roman"].alias("roman"),
            normalized_label(p["major"], p["minor"], p["roman"], col).alias("normalized"),
            F.when(sub & ~p["unnumbered"], p["major"].cast("string")).alias("parent"),
            sub.alias("is_sub"),
            (sub & p["unnumbered"]).alias("is_orphan"),
        )

    return F.when(col.isNotNull(), let(bare_label(col), from_bare))
