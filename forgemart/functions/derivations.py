"""Column derivations. Every function takes and returns ``Column`` and stays inside codegen.

Quantities and hours are stored as doubles. Where they are subtracted, compared or summed, they
are first taken as decimals, or as whole ten-thousandths in 64-bit integers where the result has
fewer places, so 0.8 - 0.7 - 0.1 is exactly zero and a flag never depends on binary noise.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from forgemart import fixed_values as fixed

EXACT = "decimal(18,4)"
SCALE = 10_000
AMOUNT = "decimal(32,16)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact(c: Column | str) -> Column:
    return _col(c).cast(EXACT)


def units(c: Column | str) -> Column:
    """A quantity in whole ten-thousandths."""
    return F.rint(_col(c).cast("double") * SCALE).cast("bigint")


def amount(c: Column | str) -> Column:
    """A value as it enters sums: a decimal of 16 places, of which sums keep 22 before the point."""
    return _col(c).cast(AMOUNT)


# ---- keys -------------------------------------------------------------------------------


def pad_key(c: Column | str, width: int = fixed.MATERIAL_WIDTH) -> Column:
    """Left-pad with zeros; longer input is kept whole, which a bare ``lpad`` would cut."""
    text = _col(c).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def strip_zeros(c: Column | str) -> Column:
    """Drop leading zeros but keep one digit of an all-zero number."""
    return F.regexp_replace(_col(c), "^0+(?=.)", "")


def same_number(a: Column | str, b: Column | str) -> Column:
    return strip_zeros(a) == strip_zeros(b)


def operation_no(sequence: Column | str) -> Column:
    """1, 2, 3 … → 0010, 0020, 0030 …"""
    return pad_key(_col(sequence) * 10, 4)


# ---- codes ------------------------------------------------------------------------------


def lookup_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def decode(c: Column | str, values: Mapping[str, str]) -> Column:
    """Text of a code, or the code itself where no text is known."""
    code = _col(c)
    return F.coalesce(F.try_element_at(lookup_map(values), code), code)


def code_to(c: Column | str, values: Mapping[str, str]) -> Column:
    """Value of a code, null where unknown."""
    return F.try_element_at(lookup_map(values), _col(c))


def _pair_map(values: Mapping[tuple[str, str], str]) -> dict[str, str]:
    return {"|".join(pair): value for pair, value in values.items()}


def mrp_controller(
    plant: Column | str,
    group: Column | str,
    controllers: Mapping[tuple[str, str], str] = fixed.MRP_CONTROLLERS,
) -> Column:
    return code_to(F.concat_ws("|", _col(plant), _col(group)), _pair_map(controllers))


def assign_work_center(
    plant: Column | str,
    role: Column | str,
    centers: Mapping[tuple[str, str], str] = fixed.ROLE_WORK_CENTERS,
) -> Column:
    return code_to(F.concat_ws("|", _col(plant), _col(role)), _pair_map(centers))


def hierarchy_key(
    group: Column | str, nodes: Mapping[str, str] = fixed.HIERARCHY_NODES
) -> Column:
    return code_to(group, nodes)


def procurement(material_type: Column | str) -> Column:
    """E (made in-house) for finished products, F (bought) for the rest."""
    return F.when(_col(material_type) == "FERT", "E").otherwise("F")


def bottleneck_flag(role: Column | str) -> Column:
    return F.when(_col(role) == fixed.BOTTLENECK_ROLE, 1).otherwise(0)


# ---- status -----------------------------------------------------------------------------


def system_status(c: Column | str) -> Column:
    return code_to(c, fixed.SYSTEM_STATUS)


def status_text(c: Column | str) -> Column:
    return decode(c, fixed.STATUS_TEXT)


def is_released(status: Column | str, ignore_case: bool = True) -> Column:
    """Status string contains REL. The upper-casing hides the column from Parquet pushdown,
    so pass ``ignore_case=False`` where the codes are known to be upper case."""
    text = F.upper(_col(status)) if ignore_case else _col(status)
    return text.contains("REL")


def backlog_flag(status: Column | str, finish: Column | str, as_of: Column | str) -> Column:
    """1 for an open order whose finish lies before ``as_of`` (a date literal or column)."""
    clock = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    late = _col(status).isin(*fixed.OPEN_STATUSES) & (_col(finish) < clock)
    return F.when(late, 1).otherwise(0)


def expected_delivered(
    status: Column | str, quantity: Column | str, fraction: Column | float
) -> Column:
    """All of the quantity once finished, a whole-piece share while partially confirmed."""
    amount = _col(quantity)
    part = fraction if isinstance(fraction, Column) else F.lit(fraction)
    share = F.floor(units(amount) * units(part) / SCALE**2).cast("double")
    return (
        F.when(_col(status).isin(*fixed.FINISHED_STATUSES), amount)
        .when(_col(status) == "PCNF", share)
        .otherwise(F.lit(0.0))
    )


def confirmed_operations(
    status: Column | str, operations: Column | str, reported: Column | str
) -> Column:
    """How many leading operations of an order are done: as many as are ``reported``, held to what
    the order's status allows. A finished order has all done, a created one none."""
    n, count = _col(operations), _col(reported)
    return (
        F.when(_col(status).isin(*fixed.FINISHED_STATUSES), n)
        .when(_col(status).isin("PCNF", "REL"), F.greatest(F.least(count, n), F.lit(0)))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def op_status(
    status: Column | str, position: Column | str, confirmed: Column | str
) -> Column:
    """Status of the operation at 1-based ``position`` when ``confirmed`` leading ones are done."""
    header, place, done = _col(status), _col(position), _col(confirmed)
    return (
        F.when(place <= done, "CNF")
        .when((header == "PCNF") & (place == done + 1), "PCNF")
        .when(header == "CRTD", "CRTD")
        .otherwise("REL")
    )


# ---- quantities and times ---------------------------------------------------------------


def rnd(c: Column | str, digits: int, half_even: bool = False) -> Column:
    """Round the decimal value once, halves away from zero or to even."""
    value = amount(c)
    return (F.bround(value, digits) if half_even else F.round(value, digits)).cast("double")


def capacity(utilization: Column | str, hours: Column | str, units: Column | str) -> Column:
    """Hours per day = utilisation percent × shift hours × parallel units."""
    hours_per_day = _col(utilization) * exact(hours) * _col(units) / 100
    return F.round(hours_per_day, 2).cast("double")


def shortage(
    required: Column | str, committed: Column | str, issued: Column | str
) -> Column:
    """Uncovered requirement, never negative, to one decimal; unknown where a quantity is."""
    gap = amount(required) - amount(committed) - amount(issued)
    return F.round(F.when(gap < 0, 0).otherwise(gap), 1).cast("double")


def missing_part(
    shortage_quantity: Column | str,
    due: Column | str | None = None,
    as_of: Column | str | None = None,
) -> Column:
    """1 for a shortage, null for an unknown one. With ``due`` and ``as_of`` (a date literal or
    column) only requirements due by then count."""
    short = _col(shortage_quantity)
    flag = F.when(short > 0, 1).when(short.isNotNull(), 0)
    if due is None:
        return flag
    clock = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return F.when(_col(due) <= clock, flag).otherwise(0)


def delay_hours(actual_end: Column | str, posting: Column | str) -> Column:
    """Hours from the real event to its posting, to two decimals, halves away from zero."""
    micros = F.unix_micros(_col(posting)) - F.unix_micros(_col(actual_end))
    hundredths = F.floor((F.abs(micros) + 18_000_000) / 36_000_000) / 100
    return F.when(micros < 0, -hundredths).otherwise(hundredths)


def sop_deviation(actual: Column | str, target: Column | str) -> Column:
    return F.round(amount(actual) - amount(target), 1).cast("double")


def op_duration(setup: Column | str, machine: Column | str) -> Column:
    """Planned days of an operation."""
    return F.greatest(
        F.lit(fixed.LEAST_OPERATION_DAYS),
        (_col(setup) + _col(machine)) / fixed.WORKDAY_HOURS,
    )


def signed_quantity(quantity: Column | str, sign: Column | str) -> Column:
    """Quantity with its movement direction; ``0`` moves nothing, an unknown sign is null."""
    direction = _col(sign)
    return (
        F.when(direction == "+", _col(quantity))
        .when(direction == "-", -_col(quantity))
        .when(direction == "0", F.lit(0.0))
    )


# ---- dates and presentation -------------------------------------------------------------


def period(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyyMM")


def to_day(c: Column | str) -> Column:
    return F.to_date(_col(c))


# Display formats of the model.
NUMBER_FORMATS = {"#,0": 0, "0.0": 1}
DATE_FORMATS = {"yyyy-mm-dd": "yyyy-MM-dd", "yyyy-mm-dd hh:nn:ss": "yyyy-MM-dd HH:mm:ss"}
PERCENT_FORMAT = "0.0%"


def fmt(c: Column | str, pattern: str) -> Column:
    """Text of a value in one of the model's display formats, halves away from zero."""
    value = _col(c)
    if pattern in DATE_FORMATS:
        return F.date_format(value, DATE_FORMATS[pattern])
    if pattern == PERCENT_FORMAT:
        share = F.round(value.cast("decimal(28,10)") * 100, 1)
        return F.concat(share.cast("string"), F.lit("%"))
    digits = NUMBER_FORMATS[pattern]
    rounded = F.round(value.cast("decimal(28,10)"), digits)
    return rounded.cast("string") if digits else F.format_number(rounded, 0)
