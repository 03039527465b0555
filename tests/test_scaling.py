"""What tasks hold and what is shuffled, as seen in plans and stored rows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from forgemart.functions.measures import distinct_of
from forgemart.operators import quality, sketches
from forgemart.plans import analyses as A
from forgemart.plans.evaluate import evaluate
from forgemart.plans.idle import idle_time
from forgemart.sources import layout
from forgemart.sources.binding import SOURCES, BoundMart


@pytest.fixture(autouse=True)
def no_broadcasts(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled_by(df, *columns: str) -> int:
    """How many exchanges deal rows out by just these columns."""
    names = ", ".join(rf"{c}#\d+L?" for c in columns)
    return len(re.findall(rf"hashpartitioning\({names}, \d+\)", plan_of(df)))


def test_bitmaps_of_small_groups_are_small(spark):
    """A group of a few values takes a few words, however many values there are in all."""
    rows = spark.range(100_000).select((F.col("id") * 7 % 2_000).alias("day"), F.col("id").alias("number"))
    daily = sketches.value_bitmaps(rows, ["day"])
    size = F.octet_length(F.col("bits").cast("string"))
    assert daily.groupBy("day").agg(F.sum(size).alias("bytes")).agg(F.max("bytes")).first()[0] <= 50 * 20
    assert sketches.bitmap_counts(sketches.merge_bitmaps(daily, []), [], "n").first()[0] == 100_000
    again = rows.unionByName(rows).unionByName(rows.select("day", F.lit(None).cast("long").alias("number")))
    counts = sketches.bitmap_counts(sketches.value_bitmaps(again, ["day"]), ["day"], "n")
    assert {r.n for r in counts.collect()} == {50}


def test_free_days_are_not_shuffled(spark):
    """A gap of years is a result of one row a day; only days with a begin or an end are summed."""
    rows = spark.sql(
        "SELECT 'w' || id % 3 AS WorkCenter, timestamp'1990-01-01 10:00:00' + make_dt_interval(id * 500) AS ActualEnd,"
        " 2.0D AS ActualMachineTime FROM range(6)"
    )
    found = idle_time(rows)
    assert shuffled_by(found, "WorkCenter", "day") == 1 and "Join" not in plan_of(found).split("hashpartitioning(WorkCenter")[0]
    days = {(r.WorkCenter, str(r.day)): (r.busy_hours, r.idle_hours, r.longest_gap_hours) for r in found.collect()}
    assert len(days) == 3 * 1501
    assert days["w0", "1990-01-01"] == (2, 14, 14)
    assert days["w0", "1992-01-01"] == (0, 24, 24)
    assert sum(busy for busy, _, _ in days.values()) == 12


def test_precedence_holds_one_table_of_orders(spark):
    """The rows of all sources are aggregated once by order, not once for each source and again."""
    moves = spark.createDataFrame([("o1", "101", 2.5), ("o1", "101", 1.0), ("o2", "261", 9.0)], "`Order` string, MovementType string, Quantity double")
    posts = spark.createDataFrame([("o2", "0010", 5.0), ("o2", "0020", 4.0), ("o1", "0010", 8.0)], "`Order` string, Operation string, YieldQuantity double")
    heads = spark.createDataFrame([("o3", 7.0), ("o3", 6.0), ("o4", None), ("o2", 1.0)], "`Order` string, DeliveredQuantity double")
    ops = spark.createDataFrame([("o4", "9990", 2.0), ("o4", "10000", 3.0), ("o5", "0010", None)], "`Order` string, Operation string, ActualQuantity double")
    found = A.delivered_by_precedence(moves, posts, heads, ops)
    assert shuffled_by(found, "Order") == 1
    assert {r["Order"]: (r.value, r.source) for r in found.collect()} == {
        "o1": (3.5, "movements"),
        "o2": (4.0, "confirmations"),
        "o3": (7.0, "headers"),
        "o4": (3.0, "operations"),
    }


def test_confirmed_only_counts_both_sides_once(spark):
    """One exchange and no sort; operations without a key allow nothing, and nothing is lost."""
    ops = [("o1", "10", "CNF"), ("o1", "20", "REL"), ("o2", "10", "CNF"), ("o2", "10", "CNF"), (None, "10", "CNF"), ("o3", None, "CNF")]
    posts = [("o1", "10"), ("o1", "20"), ("o1", "20"), ("o2", "10"), (None, "10"), ("o3", None), ("o4", "10")]
    found = quality.check_k10(
        spark.createDataFrame(ops, "`Order` string, Operation string, StatusShort string"),
        spark.createDataFrame(posts, "`Order` string, Operation string"),
        allowed=("CNF",),
    )
    assert shuffled_by(found, "Order", "Operation") == 1 and "Sort" not in plan_of(found)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(
        map(
            str,
            [
                ("o1", "20", 2, "not confirmable"),
                ("o1", "20", 2, "confirmed twice"),
                (None, "10", 1, "not confirmable"),
                ("o3", None, 1, "not confirmable"),
                ("o4", "10", 1, "not confirmable"),
            ],
        )
    )


FACTS = ("COOIS_OrderOperations", "COOIS_Confirmations", "MATDOC")


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory) -> str:
    """Orders of no, few and 2,500 line items, orders without a key, parts that are missing, and one that comes twice."""
    at = str(tmp_path_factory.mktemp("tables"))
    order = "if(id = 7, null, id)"
    rows = {
        "part": "SELECT if(id = 9, 3, nullif(id, 8)) AS p_partkey, 'part ' || id AS p_name, 'brand' AS p_brand,"
        " element_at(array('LARGE', 'PROMO', 'SMALL'), int(id % 3 + 1)) AS p_type, int(id) AS p_size, 1.5D AS p_retailprice FROM range(10)",
        "supplier": "SELECT id AS s_suppkey, 'supplier ' || id AS s_name, int(id) AS s_nationkey, 1D AS s_acctbal FROM range(5)",
        "orders": f"SELECT {order} AS o_orderkey, id AS o_custkey, element_at(array('O', 'P', 'F'), int(id % 3 + 1)) AS o_orderstatus,"
        " 1D AS o_totalprice, timestamp_ntz'1995-02-01 00:00:00' AS o_orderdate, string(id % 5 + 1) || '-X' AS o_orderpriority FROM range(12)",
        "lineitem": f"SELECT {order} AS l_orderkey, (line * 3 + id) % 11 AS l_partkey, line % 5 AS l_suppkey, int(line) AS l_linenumber,"
        " double(line % 50) AS l_quantity, 100.25D * line AS l_extendedprice, 0.05D AS l_discount, 0.02D AS l_tax,"
        " element_at(array('A', 'N', 'R'), int(line % 3 + 1)) AS l_returnflag, if(line % 2 = 0, 'F', 'O') AS l_linestatus,"
        " timestamp_ntz'1995-03-01 00:00:00' AS l_shipdate FROM (SELECT id, explode(sequence(1L, if(id = 2, 2500L, id + 1))) AS line FROM range(10))",
    }
    for name, sql in rows.items():
        df = spark.sql(sql)
        types = [part.rsplit(" ", 1) for part in SOURCES[name].split(", ")]
        df.select(*[F.col(c.strip()).cast(kind).alias(c.strip()) for c, kind in types]).write.parquet(f"{at}/{name}.parquet")
    return at


def rows_of(df) -> list[str]:
    return sorted(map(str, df.collect()))


def test_kept_line_items_feed_all_facts_without_a_shuffle(spark, root):
    plain = BoundMart(spark, root)
    kept = plain.kept()
    for name in FACTS:
        plan = plan_of(kept.table(name))
        assert "Exchange" not in plan and "Window" not in plan, name
    for name in layout.BY_ORDER:
        assert rows_of(kept.table(name)) == rows_of(plain.table(name)), name


def test_facts_dealt_by_order_once_fill_their_buckets(spark, root):
    plain = BoundMart(spark, root)
    database = layout.new_database(spark)
    dealt = plain.dealt(database, 4)
    try:
        for name in (*FACTS, "CO24"):
            df = dealt.table(name).repartition(4, "Order").sortWithinPartitions("Order")
            df.write.format("noop").mode("overwrite").save()
            df.collect()
            assert "Exchange" not in plan_of(df).split("Initial Plan")[0], name
        for name in layout.BY_ORDER:
            assert rows_of(dealt.table(name)) == rows_of(plain.table(name)), name
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


def test_buckets_grow_with_the_source(spark, root, monkeypatch):
    path = f"{root}/lineitem.parquet"
    assert layout.buckets_for(spark, path, least=16) == 16
    monkeypatch.setattr(layout, "BUCKET_BYTES", 64)
    assert layout.buckets_for(spark, path, least=16) > 16


def test_distinct_counts_join_short_dimensions_first(spark, root):
    """A centre gives way to its plant before the rows meet their orders."""
    orders = distinct_of("Orders", "COOIS_OrderOperations", "Order")
    found = evaluate(BoundMart(spark, root), [orders], ["ProductGroup.ProductGroup", "WorkCenters.WERKS"])
    keys = re.findall(r"HashAggregate\(keys=\[([^]]*)\]", plan_of(found))
    assert any("OrderOperations.Order#" in k and "WorkCenters.WERKS#" in k for k in keys)
    assert not any("OrderOperations.WorkCenter#" in k for k in keys)
