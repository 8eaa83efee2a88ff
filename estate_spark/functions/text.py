"""Number formats and text checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
BANNED_WORDS = ["leverage", "utilize", "robust", "foster", "seamless", "empower", "enhance",
                "facilitate", "streamline", "crucial", "pivotal", "vital", "showcase", "delve",
                "realm", "landscape", "testament", "underscore"]
FORBIDDEN_CHARS = [("—", "em dash"), ("–", "en dash"), ("“", "curly double quote"),
                   ("”", "curly double quote"), ("‘", "curly single quote"),
                   ("’", "curly single quote")]
NUMBER_PATTERN = r"(?<![A-Za-z0-9])\d+(?:,\d{3})*(?:\.\d+)?"


def fixed(col: Column, digits: int) -> Column:
    """Plain decimal text, half-even, no grouping."""
    return F.call_function("format_number", col, F.lit("0." + "0" * digits if digits else "0"))


def format_eur(col: Column) -> Column:
    """Grouped by thousands, no decimals, half-even."""
    return F.format_number(col, 0)


def pct1(fraction: Column) -> Column:
    return fixed(fraction * 100, 1)


def pct0(fraction: Column) -> Column:
    return fixed(fraction * 100, 0)


def plural_s(n: Column) -> Column:
    return F.when(n != 1, "s").otherwise("")


def extract_numbers(text: Column) -> Column:
    """Distinct numbers of a text, thousands separators removed; digits glued to letters
    are not numbers."""
    found = F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))))


def stray_numbers(text: Column, facts: Column) -> Column:
    return F.array_sort(F.array_except(extract_numbers(text), extract_numbers(facts)))


def char_problems(text: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(F.contains(text, F.lit(ch)), f"contains a {name}") for ch, name in FORBIDDEN_CHARS]))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def word_problems(text: Column) -> Column:
    """A banned word counts at the start of a word, in any case. The plain substring test on
    the lowered text goes first: nearly every text is done after it, without a regex."""
    def check(low: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(F.contains(low, F.lit(w)) & low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){w}"),
                   f"contains banned word '{w}'") for w in BANNED_WORDS]))
    # the long s is the one letter outside a-z that case folding equates with these words' letters
    return _let(F.translate(F.lower(text), "\u017f", "s"), check)


def missing_problems(text: Column, required: Column) -> Column:
    missing = F.filter(required, lambda r: ~F.contains(text, r))
    return F.transform(missing, lambda r: F.concat(F.lit("missing required text '"), r, F.lit("'")))


def stray_problems(text: Column, facts: Column) -> Column:
    def say(stray: Column) -> Column:
        quoted = F.array_join(F.transform(stray, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", ")
        return F.when(F.size(stray) > 0, F.array(F.concat(
            F.lit("numbers not present in the facts: ["), quoted, F.lit("]")))).otherwise(F.array().cast("array<string>"))

    return _let(stray_numbers(text, facts), say)


def validate_text(text: Column, facts: Column, required: Column) -> Column:
    """All problems of a text, in a fixed order; empty when it passes, null without a text."""
    return F.when(text.isNotNull(), F.concat(
        char_problems(text), word_problems(text), missing_problems(text, required), stray_problems(text, facts)))
