"""Numbers in text, and numbers made wrong on purpose, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerlens.functions.text import squeezed

NUMBER = r"\d[\d,]*(?:\.\d+)?"
DOTTED_DATE = r"(\d{4})\.(\d{1,2})\.(?:(\d{1,2})\.?)?"
# Dates with dots or with words for year, month and day, and ranges, count as one value.
ONE_VALUE = r"\d{4}\.\d{1,2}\.(?:\d{1,2}\.?)?|\d{4}년\s*\d{1,2}월(?:\s*\d{1,2}일)?|\d+(?:\.\d+)?\s*~\s*\d+(?:\.\d+)?"


def numbers(text: Column) -> Column:
    """Distinct numbers: dotted dates fall into their parts, commas between thousands go."""
    t = F.regexp_replace(text, DOTTED_DATE, "$1 $2 $3 ")
    t = F.regexp_replace(t, r"(?<=\d),(?=\d{3})", "")
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)))


def value_count(text: Column) -> Column:
    whole = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({ONE_VALUE})"), F.lit(1)))
    return F.size(whole) + F.size(numbers(F.regexp_replace(text, ONE_VALUE, " ")))


def fact_check(point: Column, facts: Column) -> Column:
    """(lost, added, none, crowded): numbers that went or came, no facts, positions of facts of three values or more."""
    before = numbers(point)
    after = F.array_distinct(F.flatten(F.transform(facts, numbers)))
    crowded = F.filter(F.transform(facts, lambda f, i: F.when(value_count(f) >= 3, i)), lambda i: i.isNotNull())
    return F.struct(F.sort_array(F.array_except(before, after)).alias("lost"), F.sort_array(F.array_except(after, before)).alias("added"), (F.size(facts) < 1).alias("none"), crowded.alias("crowded"))


def perturb(answer: Column, source: Column) -> Column:
    """(wrong, token): the answer with its last number changed to a likely value that the source doesn't have, else null.

    Days move by a week inside 1 to 28, months by one, years by one or two, ages by five; percentages double or gain ten
    up to 50 and drop above; small whole numbers gain one or two; all else doubles or triples. Commas and decimals stay.
    """
    found = F.regexp_extract_all(answer, F.lit(f"({NUMBER})"), F.lit(1))
    gaps = F.split(F.regexp_replace(answer, NUMBER, "\u0001"), "\u0001", -1)
    n = F.size(found)
    before = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.get(gaps, i), F.when(i < n - 1, F.get(found, i)).otherwise(""))), "")
    parts = F.when(n > 0, F.struct(F.element_at(found, -1).alias("raw"), before.alias("before"), F.element_at(gaps, -1).alias("after")))

    def rules(p: Column) -> Column:
        raw, unit = p["raw"], p["after"].substr(1, 1)
        v = F.replace(raw, F.lit(","), F.lit("")).cast("double")
        inside = lambda low, high, *values: F.filter(F.array(*values), lambda c: c.between(low, high))
        # One-letter units for day, month, year and age.
        candidates = (
            F.when((unit == "일") | ((unit == ".") & p["before"].endswith(".")), inside(1, 28, v + 7, v - 7))
            .when(unit == "월", inside(1, 12, v + 1, v - 1))
            .when(v.between(1900, 2100) & unit.isin("년", "."), F.array(v + 1, v + 2))
            .when(unit == "세", F.array(v + 5, v - 5))
            .when((unit == "%") & (v <= 50), F.array(v * 2, v + 10))
            .when(unit == "%", F.array(v - 10, v - 20))
            .when((v < 10) & (v == F.floor(v)), F.array(v + 1, v + 2))
            .otherwise(F.array(v * 2, v * 3))
        )
        decimals = F.length(F.regexp_extract(raw, r"\.(\d+)$", 1))

        def shown(c: Column) -> Column:
            long = F.call_function("format_number", c, decimals)
            return F.when(raw.contains(","), long).otherwise(F.replace(long, F.lit(","), F.lit("")))

        texts = F.transform(candidates, lambda c: F.struct(shown(c).alias("text"), F.concat(p["before"], shown(c), p["after"]).alias("wrong")))
        fit = F.filter(texts, lambda t: (t["text"] != raw) & ~squeezed(source).contains(squeezed(t["wrong"])))
        first = F.get(fit, F.lit(0))
        return F.when(first.isNotNull(), F.struct(first["wrong"].alias("wrong"), F.concat(first["text"], F.trim(unit)).alias("token")))

    return F.get(F.transform(F.filter(F.array(parts), lambda p: p.isNotNull()), rules), F.lit(0))


def scaled_first(value: Column, fallback: Column | None = None) -> Column:
    """The first whole number tripled below ten, else raised by half; without a number the fallback."""
    parts = [F.regexp_extract(value, r"(?s)^(\D*)(\d+)(.*)$", g) for g in (1, 2, 3)]
    n = parts[1].try_cast("long")
    new = F.when(n < 10, n * 3).otherwise(n + F.floor(n / 2)).cast("string")
    return F.when(parts[1] == "", F.lit("") if fallback is None else fallback).otherwise(F.concat(parts[0], new, parts[2]))
