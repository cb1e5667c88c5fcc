"""Column expressions shared by all operators.  Everything stays JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.schemas import DOLLAR_VALUES_FROM, SIC_DIVISIONS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- text ------------------------------------------------------------------
def cik10(c: Column | str) -> Column:
    """Ten-digit CIK; longer numbers are never cut, text that is no number gives NULL."""
    number = col(c).try_cast("bigint")
    return F.when(number.isNotNull(), F.format_string("%010d", number))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def normalized_text(c: Column | str) -> Column:
    """Upper case with runs of whitespace collapsed, NULL as ''."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), r"(?U)\s+", " "))


def display_name(name: Column | str, company: Column | str, cik: Column | str) -> Column:
    return F.coalesce(blank_to_null(name), blank_to_null(company), col(cik))


def contains_any(text: str, *columns: Column | str) -> Column:
    """Case-insensitive contains over several columns; % and _ in ``text`` act as wildcards."""
    return reduce(lambda a, b: a | b, [F.coalesce(col(c).ilike(f"%{text}%"), F.lit(False)) for c in columns])


# ---- dates and quarters ----------------------------------------------------
def filing_date(c: Column | str) -> Column:
    """``DD-MON-YYYY`` in any letter case to a date; blank gives NULL, other text raises."""
    return F.to_date(blank_to_null(F.upper(col(c))), "d-MMM-yyyy")


def quarter_key(date: Column | str) -> Column:
    return (F.year(col(date)) * 100 + F.quarter(col(date))).cast("int")


def quarter_year(q: Column | str) -> Column:
    q = col(q)
    return ((q - q % 100) / 100).cast("int")


def quarter_label(q: Column | str) -> Column:
    return F.concat(quarter_year(q).cast("string"), F.lit("Q"), (col(q) % 100).cast("string"))


def quarter_end(q: Column | str) -> Column:
    return F.last_day(F.make_date(quarter_year(q), (col(q) % 100).cast("int") * 3, F.lit(1)))


def previous_quarter(q: Column | str) -> Column:
    q = col(q)
    return F.when(q % 100 == 1, q - 97).otherwise(q - 1).cast("int")


def next_quarter(q: Column | str) -> Column:
    q = col(q)
    return F.when(q % 100 == 4, q + 97).otherwise(q + 1).cast("int")


def quarter_ordinal(q: Column | str) -> Column:
    """Consecutive integers for consecutive quarters."""
    return (quarter_year(q) * 4 + col(q) % 100).cast("int")


# ---- domain rules ----------------------------------------------------------
def value_multiplier(filed: Column | str) -> Column:
    return F.when(col(filed) < F.lit(DOLLAR_VALUES_FROM).cast("date"), 1000).otherwise(1).cast("bigint")


def option_type(putcall: Column | str) -> Column:
    text = F.upper(col(putcall))
    return F.when(text == "CALL", "CALL").when(text == "PUT", "PUT").otherwise("NONE")


def amount_type(unit: Column | str) -> Column:
    text = F.upper(col(unit))
    return F.when(text.isin("SH", "PRN"), text).otherwise("OTHER")


def instrument_type(option: Column | str, unit: Column | str, base_type: Column | str) -> Column:
    """Options first, then principal amounts, then the class of the CUSIP."""
    return (
        F.when(col(option) == "CALL", 5)
        .when(col(option) == "PUT", 6)
        .when(col(unit) == "PRN", 7)
        .otherwise(col(base_type))
        .cast("int")
    )


def quality_level(reconciliation: Column | str) -> Column:
    """MATCH 0, ROUNDING_DIFFERENCE 1, everything else including a missing label 2."""
    status = col(reconciliation)
    return F.when(status == "MATCH", 0).when(status == "ROUNDING_DIFFERENCE", 1).otherwise(2).cast("int")


def quality_status(level: Column | str) -> Column:
    level = col(level)
    return F.when(level == 0, "OK").when(level == 1, "ROUNDING_DIFFERENCE").otherwise("ISSUE")


def status_level(status: Column | str) -> Column:
    """Back from status text to severity; a missing side counts as OK."""
    return F.when(col(status) == "ISSUE", 2).when(col(status) == "ROUNDING_DIFFERENCE", 1).otherwise(0)


def sic_division(sic: Column | str) -> Column:
    code = col(sic)
    group = F.when(code.rlike(r"^[0-9]{2}"), F.substring(code, 1, 2).try_cast("int"))
    return F.coalesce(*[F.when(group.between(lo, hi), name) for lo, hi, name in SIC_DIVISIONS])


def turnover(gross_change: Column | str, portfolio: Column | str) -> Column:
    return F.try_divide(F.coalesce(col(gross_change), F.lit(0)) * F.lit(0.5), col(portfolio).cast("double"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Double quotient, NULL where the divisor is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def sum_if(condition: Column, value: Column | str) -> Column:
    return F.sum(F.when(condition, col(value)).otherwise(F.lit(0)).cast("bigint"))
