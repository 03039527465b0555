"""Measures by columns of any reachable dimension, over one or several facts.

A fact is never joined to another fact, so its rows are never multiplied. Where possible a fact
is summed per foreign key before it is joined to a dimension, and by what is left before each
further one (see ``partial_sums``). The partial sums of all facts are then stacked and summed once more: one
shuffle on the group columns brings all facts together, and rows without a dimension meet in the
null group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgemart.functions.measures import Measure, Part, count_of
from forgemart.operators.relations import Edge, dotted, follow, narrow_column, path, prefixed

Predicate = Callable[[Column], Column]


def _split(name: str) -> tuple[str, str]:
    table, column = name.split(".", 1)
    return table, column


def output_names(by: Sequence[str]) -> dict[str, str]:
    """``Table.column`` → column, or Table_column where two tables share the name."""
    short = [_split(b)[1] for b in by]
    return {b: c if short.count(c) == 1 else b.replace(".", "_") for b, c in zip(by, short)}


def needed(
    df: DataFrame, later: Sequence[Edge], by: Sequence[str], values: Mapping[str, Column]
) -> set[str]:
    """Columns that further joins or the groups ask for, and the values."""
    return {f"{e.many}.{e.many_key}" for e in later} | set(by) | set(values)


def dimension_map(
    mart, root: Edge, edges: Sequence[Edge], far: Sequence[str]
) -> tuple[DataFrame, set[str]]:
    """One row for each key of the root's dimension, with the wanted columns of all dimensions
    that are reached through it; and the tables it has."""
    chain, reached = [], {root.one}
    for e in edges:
        if e.many in reached:
            chain.append(e)
            reached.add(e.one)

    def columns(table: str) -> list[str]:
        onward = [e.many_key for e in chain if e.many == table]
        return list(dict.fromkeys([*onward, *(c for t, c in map(_split, far) if t == table)]))

    own = tuple(dict.fromkeys((root.one_key, *columns(root.one))))
    dims = prefixed(mart.table(root.one, *own), root.one, own)
    for e in chain:
        dims = follow(dims, mart, e, columns(e.one))
    return dims, reached


def partial_sums(
    mart, fact: str, measures: Sequence[Measure], by: Sequence[str], where: Mapping[str, Predicate]
) -> DataFrame:
    """Partial sums of one fact by the group columns, ready to be stacked.

    The dimensions that a foreign key leads to are joined to each other first, to one row a key, so
    a fact meets each of its keys once. Rows are summed per key before the first such join if that
    is the only column they are still told apart by: the sums are then partitioned just as the join
    needs, and a key shared by very many rows (or by all rows without a key) is one row. With more
    columns that join stays a plain one, in which adaptive execution splits an overlarge key. Before
    each later join, rows are summed by what is left of them: dimension columns and further keys.
    """
    values = {
        f"{m.alias}#{i}": part.value()
        for m in measures
        for i, part in enumerate(m.parts)
        if part.additive
    }
    sums = [F.sum(dotted(c)).alias(c) for c in values]

    def summed(df: DataFrame, kept: Sequence[str], at: int) -> DataFrame:
        return df.groupBy(*map(dotted, kept)).agg(*sums) if len(kept) == 1 or at > 0 else df

    columns = [c for m in measures for c in m.columns]
    return _joined(mart, fact, columns, values, by, where, summed)


def distinct_values(
    mart, fact: str, part: Part, by: Sequence[str], where: Mapping[str, Predicate], columns: Sequence[str]
) -> DataFrame:
    """The set of values that a distinct count has in each group: one row a group and value.

    Sets, unlike counts, can be joined on and grouped further. A value is a group column of its own,
    so that a frequent group is spread over its values, and rows shrink to distinct ones before each
    join but the first. Dimensions that lead to fewest others come first: their key gives way to what
    is wanted of them, so that fewer rows are left for the others, and a task that joins those holds
    fewer. Groups without values keep one row, of a null value.
    """
    def distinct(df: DataFrame, kept: Sequence[str], at: int) -> DataFrame:
        return df.distinct() if at > 0 else df

    return _joined(
        mart, fact, columns, {"#value": part.value()}, by, where, distinct, short_first=True
    ).distinct()


def _joined(
    mart,
    fact: str,
    columns: Sequence[str],
    values: Mapping[str, Column],
    by: Sequence[str],
    where: Mapping[str, Predicate],
    reduce_rows: Callable[[DataFrame, Sequence[str], int], DataFrame],
    short_first: bool = False,
) -> DataFrame:
    """Group columns and values of a fact's rows that pass the filters; ``reduce_rows`` may shrink
    the rows, told apart by some columns, before the join of that number. Joins come in the order of
    the columns, or those of the shortest paths first."""
    wanted = list(dict.fromkeys([*by, *where]))
    far = [c for c in wanted if _split(c)[0] != fact]
    edges = list(dict.fromkeys(e for c in far for e in path(fact, _split(c)[0])))

    own = [_split(c)[1] for c in wanted if _split(c)[0] == fact]
    keys = [e.many_key for e in edges if e.many == fact]
    read = [*own, *keys, *columns]
    df = mart.table(fact, *dict.fromkeys(read or [narrow_column(fact)]))
    for name in where:
        if name not in far:
            df = df.where(where[name](F.col(_split(name)[1])))

    group = list(dict.fromkeys([_split(c)[1] for c in by if c not in far] + keys))
    df = df.select(
        *[F.col(c).alias(f"{fact}.{c}") for c in group],
        *[value.alias(name) for name, value in values.items()],
    )

    roots = [e for e in edges if e.many == fact]
    if short_first:
        longest = {r: max(len(p) for c in far if (p := path(fact, _split(c)[0]))[0] == r) for r in roots}
        roots.sort(key=longest.get)
    for at, root in enumerate(roots):
        df = df.select(*[dotted(c) for c in df.columns if c in needed(df, roots[at:], by, values)])
        df = reduce_rows(df, [c for c in df.columns if c not in values], at)
        dims, reached = dimension_map(mart, root, edges, far)
        same = dotted(f"{fact}.{root.many_key}") == dotted(f"{root.one}.{root.one_key}")
        df = df.join(dims, same, "left")
        for name in far:
            if name in where and _split(name)[0] in reached:
                df = df.where(where[name](dotted(name)))
    return df.select(
        *[dotted(b).alias(n) for b, n in output_names(by).items()], *[dotted(c) for c in values]
    )


def finish(measures: Sequence[Measure], df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum the partial sums and form the measures. Without groups a count over no rows is 0; in a
    group that only another fact has, it is null."""
    def total(m: Measure, i: int) -> Column:
        value = F.sum(dotted(f"{m.alias}#{i}"))
        counts = m.parts[i].kind != "sum" and not by
        return F.coalesce(value, F.lit(0)) if counts else value

    results = [
        m.final([total(m, i) for i in range(len(m.parts))]).alias(m.alias) for m in measures
    ]
    return df.groupBy(*by).agg(*results)


def evaluate(
    mart,
    measures: Sequence[Measure],
    by: Sequence[str] = (),
    where: Mapping[str, Predicate] | None = None,
) -> DataFrame:
    """Measures grouped ``by`` and filtered by ``where`` (``Table.column`` → predicate).

    Group columns come first, named by their column; then one column per measure alias. A
    table that a fact cannot reach raises an error naming both. A measure with an overriding
    condition ignores filters and grouping on the columns it overrides: its value is shown
    beside every group that the other measures have.
    """
    where = dict(where or {})
    names = output_names(by)
    plain = [m for m in measures if not m.replaces]
    overriding = [m for m in measures if m.replaces]

    result = _stacked(mart, plain, by, where) if plain else None
    for m in overriding:
        hidden = {f"{m.fact}.{c}" for c in m.replaces}
        kept = [b for b in by if b not in hidden]
        single = _stacked(mart, [m], kept, {k: v for k, v in where.items() if k not in hidden})
        if result is None:
            result = _groups(mart, m.fact, by, where)
        result = _beside(result, single, [names[b] for b in kept], m.alias)
    return result.select(*names.values(), *[m.alias for m in measures])


def _stacked(
    mart, measures: Sequence[Measure], by: Sequence[str], where: Mapping[str, Predicate]
) -> DataFrame:
    names = list(output_names(by).values())
    sides = _additive_sides(mart, measures, by, where)
    for column, values in _distinct_sides(mart, measures, by, where):
        sides.append(values.groupBy(*names).agg(F.count(dotted("#value")).alias(column)))
    return finish(measures, _stack(sides), names)


def _stack(sides: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)


def _additive_sides(
    mart, measures: Sequence[Measure], by: Sequence[str], where: Mapping[str, Predicate]
) -> list[DataFrame]:
    """Partial sums of each fact that has any."""
    facts: dict[str, list[Measure]] = {}
    for m in measures:
        if any(p.additive for p in m.parts):
            facts.setdefault(m.fact, []).append(m)
    return [partial_sums(mart, fact, own, by, where) for fact, own in facts.items()]


def _distinct_sides(
    mart, measures: Sequence[Measure], by: Sequence[str], where: Mapping[str, Predicate]
) -> list[tuple[str, DataFrame]]:
    """The sets of values of each distinct count, under the name of its partial."""
    return [
        (f"{m.alias}#{i}", distinct_values(mart, m.fact, part, by, where, m.columns))
        for m in measures
        for i, part in enumerate(m.parts)
        if not part.additive
    ]


def evaluate_levels(
    mart,
    measures: Sequence[Measure],
    by: Sequence[str],
    where: Mapping[str, Predicate] | None = None,
    cube: bool = False,
) -> DataFrame:
    """``evaluate`` with subtotals over the last group columns, or with ``cube`` over any of them.

    ``subtotal_level`` is 0 for a plain group and has one bit per group column summed over, the last
    column's being the lowest; it tells a subtotal from the group of rows that have no value. Partial
    sums of all facts are stacked and summed by all group columns before they are rolled up, and
    measures are formed from the sums of each level, so a ratio is one of sums there. Distinct counts
    roll up their sets of values. Measures with an overriding condition are not taken.
    """
    if any(m.replaces for m in measures):
        raise ValueError("subtotals need measures without overriding conditions")
    where, names = dict(where or {}), list(output_names(by).values())
    width = len(names)
    levels = [
        [n for at, n in enumerate(names) if not hidden >> (width - 1 - at) & 1]
        for hidden in (range(1 << width) if cube else ((1 << k) - 1 for k in range(width + 1)))
    ]
    sides = []
    if additive := _additive_sides(mart, measures, by, where):
        stacked = _stack(additive)
        sums = [F.sum(dotted(c)).alias(c) for c in stacked.columns if c not in names]
        groups = stacked.groupBy(*names).agg(*sums)
        level = F.grouping_id().alias("subtotal_level")
        sides.append(groups.groupingSets(levels, *names).agg(level, *sums))
    for column, values in _distinct_sides(mart, measures, by, where):
        sets = values.withColumnRenamed("#value", "_value").groupingSets(
            [[*level, "_value"] for level in levels], *names, "_value"
        )
        told = sets.agg(F.shiftright(F.grouping_id(), 1).alias("subtotal_level"))
        sides.append(told.groupBy(*names, "subtotal_level").agg(F.count("_value").alias(column)))
    result = finish(measures, _stack(sides), [*names, "subtotal_level"])
    return result.select(*names, "subtotal_level", *[m.alias for m in measures])


def _groups(mart, fact: str, by: Sequence[str], where: Mapping[str, Predicate]):
    """The groups to show when every measure overrides; none when nothing is grouped."""
    if not by:
        return None
    rows = _stacked(mart, [count_of("rows", fact)], by, where)
    return rows.select(*output_names(by).values())


def _beside(groups: DataFrame | None, single: DataFrame, keys: list[str], alias: str) -> DataFrame:
    """Put an overriding measure beside the groups of the other measures."""
    if groups is None:
        return single
    if not keys:
        # No group column is left, so the measure is a single value.
        return groups.select("*", single.scalar().alias(alias))
    left, right = groups.alias("g"), single.alias("s")
    same = reduce(lambda a, b: a & b, [F.col(f"g.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    return left.join(right, same, "left").select("g.*", F.col(f"s.{alias}"))
