"""Named measures as sums and counts that can be taken in steps.

A measure is a set of parts. Every part is a sum or a count over rows of one fact, so it can be
taken per foreign key before a join and summed again afterwards; ratios and averages are formed
from the summed parts only. Counts of distinct values can't be summed: their parts are sets of
values, which ``evaluate`` counts where the groups are known. Sums run on decimals of 16 places:
results do not depend on the order in which partitions arrive, and an overflow raises instead of
wrapping.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from forgemart.functions.derivations import amount, is_released


def exact_sum(c: Column | str) -> Column:
    return F.sum(amount(c)).cast("double")


def exact_avg(c: Column | str) -> Column:
    return F.try_divide(exact_sum(c), F.count(c))


@dataclass(frozen=True)
class Part:
    kind: str  # "sum", "count" (of non-null values), "rows" or "distinct" (non-null values)
    column: str = ""
    keep: Callable[[], Column] | None = None

    @property
    def additive(self) -> bool:
        """Whether the part of a whole is the sum of its parts': not so for distinct values."""
        return self.kind != "distinct"

    def value(self) -> Column:
        """What one row adds to the part, or the value that it counts."""
        keep = self.keep() if self.keep else F.lit(True)
        if self.kind == "sum":
            return F.when(keep, amount(self.column))
        if self.kind == "distinct":
            return F.when(keep, F.col(self.column))
        counted = keep if self.kind == "rows" else keep & F.col(self.column).isNotNull()
        return F.when(counted, 1).otherwise(0).cast("bigint")

    def aggregate(self) -> Column:
        keep = self.keep() if self.keep else None
        if self.kind == "rows":
            return F.count(F.lit(1)) if keep is None else F.count_if(keep)
        value = amount(self.column) if self.kind == "sum" else F.col(self.column)
        if keep is not None:
            value = F.when(keep, value)
        if self.kind == "distinct":
            return F.count_distinct(value)
        return F.sum(value) if self.kind == "sum" else F.count(value)


@dataclass(frozen=True)
class Measure:
    """``columns`` are all fact columns the measure reads; ``replaces`` are those whose outer
    filters and grouping it ignores."""

    name: str
    fact: str
    parts: tuple[Part, ...]
    final: Callable[[Sequence[Column]], Column]
    columns: tuple[str, ...] = ()
    replaces: tuple[str, ...] = ()

    @property
    def alias(self) -> str:
        words = "".join(c if c.isalnum() else " " for c in self.name).lower().split()
        return "_".join(words)

    def column(self) -> Column:
        """The measure as one aggregate over the fact's rows."""
        return self.final([part.aggregate() for part in self.parts]).alias(self.alias)

    def named(self, name: str) -> Measure:
        return replace(self, name=name)

    def where(
        self,
        keep: Callable[[], Column],
        columns: Sequence[str] = (),
        override: bool = False,
    ) -> Measure:
        """The measure over the rows that also meet ``keep``, which reads ``columns``.

        With ``override`` the condition takes the place of any outer filter or grouping on
        those columns, beside those that earlier ones replace; without it, it narrows the outer
        selection further.
        """
        def both(old: Callable[[], Column] | None) -> Callable[[], Column]:
            return keep if old is None else lambda: old() & keep()

        return replace(
            self,
            parts=tuple(replace(p, keep=both(p.keep)) for p in self.parts),
            columns=tuple(dict.fromkeys((*self.columns, *columns))),
            replaces=tuple(dict.fromkeys((*self.replaces, *columns))) if override else self.replaces,
        )

    @staticmethod
    def compose(
        name: str, expr: Callable[[Sequence[Column]], Column], *measures: Measure
    ) -> Measure:
        """A measure computed from other measures of the same fact, in one pass over it."""
        first = measures[0]
        if any((m.fact, m.replaces) != (first.fact, first.replaces) for m in measures):
            raise ValueError(f"{name}: composed measures need one fact and one filter context")

        def final(values: Sequence[Column]) -> Column:
            results, at = [], 0
            for m in measures:
                results.append(m.final(values[at : at + len(m.parts)]))
                at += len(m.parts)
            return expr(results)

        return Measure(
            name,
            first.fact,
            tuple(p for m in measures for p in m.parts),
            final,
            tuple(dict.fromkeys(c for m in measures for c in m.columns)),
            first.replaces,
        )


def count_of(name: str, fact: str) -> Measure:
    return Measure(name, fact, (Part("rows"),), lambda v: v[0])


def sum_of(name: str, fact: str, column: str) -> Measure:
    return Measure(name, fact, (Part("sum", column),), lambda v: v[0].cast("double"), (column,))


def distinct_of(name: str, fact: str, column: str) -> Measure:
    """How many different values a column of a fact has."""
    return Measure(name, fact, (Part("distinct", column),), lambda v: v[0], (column,))


def average_of(name: str, fact: str, column: str) -> Measure:
    parts = (Part("sum", column), Part("count", column))
    return Measure(name, fact, parts, lambda v: F.try_divide(v[0].cast("double"), v[1]), (column,))


def _is_one(column: str) -> Callable[[], Column]:
    return lambda: F.col(column) == 1


def _model() -> dict[str, Measure]:
    headers, operations = "COOIS_OrderHeaders", "COOIS_OrderOperations"
    confirmations, sop = "COOIS_Confirmations", "SOP_Targets"
    orders = count_of("Order Count", headers)
    ops = count_of("Operation Count", operations)
    scrap = sum_of("Total Scrap", confirmations, "ScrapQuantity")
    good = sum_of("Total Yield", confirmations, "YieldQuantity")
    # The names of the model's measures.
    measures = [
        orders,
        orders.where(lambda: is_released("SystemStatus"), ["SystemStatus"]).named(
            "Released Order Load"
        ),
        orders.where(_is_one("Backlog"), ["Backlog"]).named("Backlog Order Count"),
        sum_of("Total Order Quantity", headers, "OrderQuantity"),
        sum_of("Total Delivered Quantity", headers, "DeliveredQuantity"),
        ops,
        ops.where(_is_one("BottleneckOperation"), ["BottleneckOperation"]).named(
            "Bottleneck Operation Count (Laser Balancing)"
        ),
        good,
        scrap,
        sum_of("Total Rework", confirmations, "ReworkQuantity"),
        Measure.compose("Scrap Rate", lambda m: F.try_divide(m[0], m[1]), scrap, good),
        average_of("Avg Posting Delay Hours", confirmations, "DelayHours"),
        count_of("Missing Part Count", "CO24").where(_is_one("MissingPart"), ["MissingPart"]),
        sum_of("Total Shortage Quantity", "CO24", "ShortageQuantity"),
        sum_of("Total Target Quantity", sop, "TargetQuantity"),
        sum_of("Total SOP Actual Quantity", sop, "ActualQuantity"),
        sum_of("SOP Deviation", sop, "Deviation"),
    ]
    return {m.name: m for m in measures}


MEASURES = _model()

# Display format of the measures that are not plain whole numbers.
MEASURE_FORMATS = {"Scrap Rate": "0.0%", "Avg Posting Delay Hours": "0.0"}


def measure(name: str) -> Measure:
    return MEASURES[name]


def format_of(name: str) -> str:
    return MEASURE_FORMATS.get(name, "#,0")
