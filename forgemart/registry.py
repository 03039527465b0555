"""Every operator and question as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgemart import fixed_values as fixed
from forgemart.functions import derivations as D
from forgemart.functions.measures import Measure, distinct_of, measure
from forgemart.operators import joins, quality, sketches, totals
from forgemart.operators.generate import expand_locations, expand_routing, periods, sop_grid
from forgemart.operators.relations import EDGES, join_edge, orphans, widen
from forgemart.operators.schedule import schedule
from forgemart.operators.skew import lookup
from forgemart.plans import analyses as A
from forgemart.plans.evaluate import evaluate, evaluate_levels
from forgemart.plans.idle import idle_time
from forgemart.sources import binding as B
from forgemart.sources import schema as S
from forgemart.sources import layout, storage
from forgemart.sources.binding import BoundMart
from forgemart.sources.case_blind import CaseBlindMart
from forgemart.sources.mart import CatalogMart, FrameMart, StoredMart, store
from forgemart.sources.steps import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HEADERS = "COOIS_OrderHeaders"
OPERATIONS = "COOIS_OrderOperations"
CONFIRMATIONS = "COOIS_Confirmations"


def query(build: Callable[[BoundMart], DataFrame], name: str | None = None):
    QUERIES[name or build.__name__] = lambda spark, root: _widened(build(BoundMart(spark, root)))
    return build


def _widened(df: DataFrame) -> DataFrame:
    """Results show every whole number as a bigint."""
    return df.selectExpr(
        *[
            f"CAST(`{f.name}` AS BIGINT) AS `{f.name}`"
            if isinstance(f.dataType, T.IntegerType)
            else f"`{f.name}`"
            for f in df.schema
        ]
    )


def _flat(df: DataFrame) -> DataFrame:
    """``Table.column`` names as Table_column."""
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


# ---- scans, sources, sinks --------------------------------------------------------------


def _stored(m: BoundMart) -> StoredMart:
    root = storage.new_root(m.spark)
    store(m.kept(), root)
    return StoredMart(m.spark, root)


@query
def s01_scan(m):
    stored = _stored(m)
    return reduce(
        DataFrame.unionByName, [storage.scan_profile(t, stored.table(t)) for t in S.TABLES]
    )


@query
def s02_map_columns(m):
    names = {"l_orderkey": "Order", "l_partkey": "Component", "l_quantity": "Reqmnt_qty"}
    return storage.map_columns(m.source("lineitem"), names)


@query
def s03_conform(m):
    """Types off on purpose: a whole number for a double, a fraction for an int, nulls."""
    lines = m.source("lineitem")
    loose = lines.select(
        F.col("l_orderkey").alias("Order"),
        F.col("l_partkey").alias("Component"),
        F.lit(None).cast("string").alias("WERKS"),
        F.col("l_returnflag").alias("LGORT"),
        F.col("l_linenumber").alias("Reqmnt_qty"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("string")).alias("Comm_qty"),
        F.col("l_suppkey").alias("Qty_issued"),
        F.col("l_discount").alias("ShortageQuantity"),
        (-F.col("l_extendedprice")).alias("MissingPart"),
        F.col("l_shipdate").alias("RequirementDate"),
        F.col("l_linestatus").alias("ComponentText"),
    )
    return storage.conform(loose, "CO24")


@query
def s04_overwrite(m):
    root = storage.new_root(m.spark)
    storage.save(m.table("MARC"), root, "MARA")
    storage.save(m.table("MARA"), root, "MARA")
    return storage.load(m.spark, root, "MARA")


@query
def s05_row_counts(m):
    stored = _stored(m)
    return storage.row_counts({t: stored.table(t) for t in S.TABLES})


@query
def s06_run_log(m):
    root, m = storage.new_root(m.spark), m.kept()

    def save(table: str) -> Callable[[], int]:
        def step() -> int:
            storage.save(storage.conform(m.table(table), table), root, table)
            return storage.load(m.spark, root, table).count()

        return step

    return storage.run_steps(m.spark, root, [(f"save {t}", save(t)) for t in S.TABLES])


@query
def s07_refresh(m):
    root = storage.new_root(m.spark)
    storage.save(m.table("D_Part"), root, "MARD")
    storage.save(m.table("MARD"), root, "MARD")
    return storage.refresh(m.spark, root, "MARD")


@query
def s08_validate(m):
    """All tables stored, but one left out, one without a column, one with a type changed; then
    each finding with the rows that the stored table has."""
    root, m = storage.new_root(m.spark), m.kept()
    tables = {t: storage.conform(m.table(t), t) for t in S.TABLES if t != "MATDOC"}
    tables["CO24"] = tables["CO24"].drop("MissingPart")
    tables["MARC"] = tables["MARC"].withColumn("DZEIT", F.col("DZEIT").cast("string"))
    for table, df in tables.items():
        storage.save(df, root, table)
    stored = storage.stored_tables(m.spark, root)
    counts = storage.row_counts(stored)
    return storage.validate(m.spark, stored).join(counts, "table", "left")


def _by_order(m) -> CatalogMart:
    database = layout.new_database(m.spark)
    buckets = layout.buckets_for(m.spark, f"{m.root}/lineitem.parquet", least=16)
    layout.store_by_order(m.dealt(database, buckets), database, buckets)
    return CatalogMart(m.spark, database)


@query
def s09_by_order(m):
    """Rows of the four facts that meet their header, from tables stored in buckets by order."""
    mart = _by_order(m)
    headers = mart.table(HEADERS, "Order", "StatusShort")
    return reduce(
        DataFrame.unionByName,
        [
            mart.table(fact, "Order")
            .join(headers, "Order")
            .groupBy("StatusShort")
            .agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(fact).alias("table"), "StatusShort", "rows")
            for fact in layout.BY_ORDER[1:]
        ],
    )


@query
def s10_periods(m):
    """Confirmations stored by month; one month is written anew with twice the yield, the others stay;
    then the months of one year are read through a dimension of periods."""
    root = storage.new_root(m.spark)
    rows = m.table(CONFIRMATIONS, "Order", "Operation", "ActualEnd", "YieldQuantity")
    layout.save_partitioned(layout.with_period(rows, "ActualEnd"), root, CONFIRMATIONS)
    stored = layout.load_partitioned(m.spark, root, CONFIRMATIONS)
    again = stored.where("Period = '199503'").withColumn("YieldQuantity", F.col("YieldQuantity") * 2)
    layout.replace_partitions(written(again), root, CONFIRMATIONS)
    stored = layout.load_partitioned(m.spark, root, CONFIRMATIONS)
    year = periods(m.spark.range(1), F.lit("1995-01-01").cast("date"), 12).select("Period")
    return (
        stored.join(F.broadcast(year), "Period")
        .groupBy("Period")
        .agg(F.count(F.lit(1)).alias("rows"), totals.exact_sum("YieldQuantity").alias("total_yield"))
    )


@query
def s11_swap(m):
    """Rows and delivered quantity of a table before and after its rows were swapped, both read from
    frames that were made at their time."""
    database = layout.new_database(m.spark)
    headers = m.table(HEADERS, "Order", "StatusShort", "DeliveredQuantity")
    layout.swap_table(headers, database, HEADERS)
    before = storage.load_table(m.spark, database, HEADERS)
    open_orders = headers.where("StatusShort IN ('CRTD', 'REL', 'PCNF')")
    layout.swap_table(open_orders, database, HEADERS)
    after = storage.load_table(m.spark, database, HEADERS)

    def told(name: str, df: DataFrame) -> DataFrame:
        quantity = totals.exact_sum("DeliveredQuantity").alias("delivered")
        return df.agg(F.count(F.lit(1)).alias("rows"), quantity).select(F.lit(name).alias("state"), "*")

    return told("before", before).unionByName(told("after", after))


# ---- derivations ------------------------------------------------------------------------


def _role():
    return F.try_element_at(F.array(*[F.lit(r) for r in B.ROLES]), F.col("l_linenumber"))


@query
def d01_pad_key(m):
    return m.source("orders").select(
        "o_orderkey",
        D.pad_key("o_orderkey").alias("key18"),
        D.pad_key("o_orderkey", fixed.CONFIRMATION_WIDTH).alias("key12"),
        D.pad_key("o_orderkey", fixed.DOCUMENT_WIDTH).alias("key10"),
        D.pad_key("o_orderkey", 3).alias("key3"),
    )


@query
def d02_same_number(m):
    order = D.pad_key("o_orderkey")
    return m.source("orders").select(
        order.alias("Order"),
        D.strip_zeros(order).alias("number"),
        D.same_number(order, F.col("o_orderkey").cast("string")).cast("int").alias("same_order"),
        D.same_number(order, F.col("o_custkey").cast("string")).cast("int").alias("same_customer"),
    )


@query
def d03_code_text(m):
    code = F.when(F.col("l_linestatus") == "O", _role()).otherwise(F.lit("GRIND"))
    return m.source("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        code.alias("code"),
        D.decode(code, fixed.ROLE_TEXT).alias("code_text"),
    )


@query
def d04_system_status(m):
    return m.table(HEADERS, "Order", "StatusShort").withColumn(
        "derived_status", D.system_status("StatusShort")
    )


@query
def d05_released(m):
    df = m.table(HEADERS, "Order", "SystemStatus")
    return df.select(
        "Order",
        D.is_released(F.lower("SystemStatus")).cast("int").alias("released"),
        D.is_released("SystemStatus", ignore_case=False).cast("int").alias("released_exact"),
    )


@query
def d06_backlog(m):
    df = m.table(HEADERS, "Order", "StatusShort", "FinishDate")
    flag = D.backlog_flag("StatusShort", "FinishDate", "1998-07-15")
    return df.select("Order", flag.alias("backlog"))


@query
def d07_capacity(m):
    df = m.table("WorkCenters", "WorkCenter", "NGRAD", "EINZH", "AZNOR")
    return df.select("WorkCenter", D.capacity("NGRAD", "EINZH", "AZNOR").alias("capacity"))


@query
def d08_shortage(m):
    df = m.table(
        "CO24", "Order", "Component", "Reqmnt_qty", "Comm_qty", "Qty_issued", "RequirementDate"
    )
    gap = D.shortage("Reqmnt_qty", "Comm_qty", "Qty_issued")
    return df.select(
        "Order",
        "Component",
        "RequirementDate",
        gap.alias("shortage"),
        D.missing_part(gap).alias("missing"),
        D.missing_part(gap, "RequirementDate", B.AS_OF).alias("missing_and_due"),
    )


@query
def d09_posting_delay(m):
    df = m.table(CONFIRMATIONS, "Order", "WorkCenter", "ActualEnd", "SAP_PostingTime")
    return df.withColumn("delay", D.delay_hours("ActualEnd", "SAP_PostingTime"))


@query
def d10_sop_deviation(m):
    keys = ["ProductGroup", "WERKS", "Period"]
    df = m.table("SOP_Targets", *keys, "ActualQuantity", "TargetQuantity")
    return df.select(*keys, D.sop_deviation("ActualQuantity", "TargetQuantity").alias("deviation"))


@query
def d11_period(m):
    df = m.table("MATDOC", "Order", "Matnr", "PostingDate", "DocumentDate")
    return df.select(
        "Order",
        "Matnr",
        D.period("PostingDate").alias("posting_period"),
        D.period("DocumentDate").alias("document_period"),
    )


@query
def d12_procurement(m):
    return m.table("MARA", "MATNR", "MTART").withColumn("BESKZ", D.procurement("MTART"))


@query
def d13_mrp_controller(m):
    controller = D.mrp_controller(
        B.plant_of(F.col("p_partkey")), "p_type", B.BOUND_CONTROLLERS
    )
    return m.source("part").select("p_partkey", "p_type", controller.alias("DISPO"))


@query
def d14_bottleneck_flag(m):
    return m.source("lineitem").select(
        "l_orderkey", "l_linenumber", D.bottleneck_flag(_role()).alias("flag")
    )


@query
def d15_operation_no(m):
    return m.table(OPERATIONS, "Order", "Operation", "WorkCenter")


@query
def d16_work_center(m):
    plant = B.plant_of(F.col("l_partkey"))
    return m.source("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        plant.alias("WERKS"),
        D.assign_work_center(plant, _role()).alias("WorkCenter"),
    )


@query
def d17_op_duration(m):
    df = m.table(OPERATIONS, "Order", "WorkCenter", "SetupTime", "MachineTime")
    return df.withColumn("duration_days", D.op_duration("SetupTime", "MachineTime"))


@query
def d18_schedule(m):
    starts = m.table(HEADERS, "Order", "StartDate").withColumnRenamed("StartDate", "OrderStart")
    ops = m.table(OPERATIONS, "Order", "Operation", "SetupTime", "MachineTime")
    timed = ops.join(starts, "Order", "left")
    return schedule(timed, gap_hours=6).select(
        "Order", "Operation", "ScheduledStart", "ScheduledEnd"
    )


@query
def d19_op_status(m):
    """As many leading operations are done as the order has confirmed ones."""
    headers = m.table(HEADERS, "Order", "StatusShort")
    ops = m.table(OPERATIONS, "Order", "Operation", "StatusShort").select(
        "Order",
        "Operation",
        F.floor(quality.operation_number() / 10).alias("position"),
        (F.col("StatusShort") == "CNF").alias("confirmed"),
    )
    counts = ops.groupBy("Order").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("confirmed").alias("reported")
    )
    plan = headers.join(counts, "Order").select(
        F.col("Order").alias("plan_order"),
        "StatusShort",
        D.confirmed_operations("StatusShort", "n", "reported").alias("done"),
    )
    return lookup(ops, plan, "Order", "plan_order").select(
        "Order", "Operation", D.op_status("StatusShort", "position", "done").alias("op_status")
    )


@query
def d20_delivered(m):
    df = m.table(HEADERS, "Order", "StatusShort", "OrderQuantity")
    share = (F.col("Order").cast("bigint") % 5 + 3) / 10
    return df.withColumn("delivered", D.expected_delivered("StatusShort", "OrderQuantity", share))


@query
def d21_hierarchy_key(m):
    return m.source("part").select(
        "p_partkey", D.hierarchy_key("p_type", B.BOUND_NODES).alias("PRDHA")
    )


@query
def d22_signed_qty(m):
    moves = m.table("MATDOC", "Order", "Matnr", "MovementType", "Quantity")
    return joins.with_movement_type(moves, m.table("MovementTypes")).select(
        "Order", "Matnr", "MovementType", "SignedQuantity"
    )


@query
def d23_to_date(m):
    return m.table(CONFIRMATIONS, "Order", "ActualEnd", "SAP_PostingTime").select(
        "Order",
        D.to_day("ActualEnd").alias("end_day"),
        D.to_day("SAP_PostingTime").alias("posting_day"),
    )


@query
def d24_round(m):
    return m.source("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        D.rnd("l_extendedprice", 1).alias("half_up"),
        D.rnd("l_extendedprice", 1, half_even=True).alias("half_even"),
        D.rnd(F.col("l_extendedprice") / 4, 2).alias("quarter"),
    )


@query
def d25_format(m):
    return m.source("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        D.fmt("l_extendedprice", "#,0").alias("whole"),
        D.fmt("l_extendedprice", "0.0").alias("one_digit"),
        D.fmt("l_discount", "0.0%").alias("percent"),
        D.fmt("l_shipdate", "yyyy-mm-dd").alias("day"),
        D.fmt("l_shipdate", "yyyy-mm-dd hh:nn:ss").alias("moment"),
    )


@query
def d26_status_text(m):
    return m.table(HEADERS, "Order", "StatusShort").withColumn(
        "status_text", D.status_text("StatusShort")
    )


@query
def d27_filter_eq(m):
    return m.table(OPERATIONS, "Order", "WorkCenter", "BottleneckOperation").where(
        F.col("BottleneckOperation") == 1
    ).select("Order", "WorkCenter")


@query
def d28_filter_in(m):
    return m.table(HEADERS, "Order", "StatusShort").where(
        F.col("StatusShort").isin(*fixed.OPEN_STATUSES)
    )


# ---- row generators ---------------------------------------------------------------------


@query
def x01_routing(m):
    orders = m.table(HEADERS, "Order", "ProductGroup")
    return expand_routing(orders, B.BOUND_ROUTINGS)


@query
def x02_storage_locations(m):
    return expand_locations(m.table("MARC", "MATNR", "WERKS"))


@query
def x03_periods(m):
    span = m.table("SOP_Targets", "ProductGroup", "Period").groupBy("ProductGroup").agg(
        F.to_date(F.min("Period"), "yyyyMM").alias("first"),
        F.to_date(F.max("Period"), "yyyyMM").alias("last"),
    )
    n = F.months_between("last", "first").cast("int") + 7
    return periods(span, F.col("first"), n).select("ProductGroup", "Period")


@query
def x04_sop_grid(m):
    """From the first to the last period with actuals."""
    keys = ["ProductGroup", "Period", "WERKS"]
    actuals = m.table("SOP_Targets", *keys, "ActualQuantity")
    first = actuals.select(F.to_date(F.min("Period"), "yyyyMM")).scalar()
    last = actuals.select(F.to_date(F.max("Period"), "yyyyMM")).scalar()
    n = F.months_between(last, first).cast("int") + 1
    return sop_grid(m.table("ProductGroup"), first, n).join(actuals, keys, "left")


# ---- joins ------------------------------------------------------------------------------

# Query → edge, columns of the many side, columns of the one side.
EDGE_QUERIES = {
    "j00_marc_mara": ("J0", ["MATNR", "WERKS"], ["MATNR", "MTART"]),
    "j01_mard_mara": ("J1", ["MATNR", "LGORT", "LABST"], ["MATNR", "MATKL"]),
    "j02_dpart_mara": ("J2", ["MATNR", "ABC_Class"], ["MATNR", "NTGEW"]),
    "j03_mara_pg": ("J3", ["MATNR", "ProductGroup"], ["ProductGroup", "Description"]),
    "j04_mara_hier": ("J4", ["MATNR", "PRDHA"], ["ProductHierarchy", "Level", "Parent"]),
    "j05_marc_mrp": ("J5", ["MATNR", "DISPO"], ["DISPO", "Name"]),
    "j06_hdr_mara": ("J6", ["Order", "Material", "OrderQuantity"], ["MATNR", "MTART"]),
    "j07_ops_hdr": ("J7", ["Order", "WorkCenter", "MachineTime"], ["Order", "StatusShort"]),
    "j08_ops_wc": ("J8", ["Order", "WorkCenter", "SetupTime"], ["WorkCenter", "Bottleneck"]),
    "j09_conf_hdr": ("J9", ["Order", "YieldQuantity"], ["Order", "Priority"]),
    "j10_conf_wc": ("J10", ["Order", "WorkCenter", "ScrapQuantity"], ["WorkCenter", "NGRAD"]),
    "j11_co24_hdr": ("J11", ["Order", "Component", "ShortageQuantity"], ["Order", "FinishDate"]),
    "j12_matdoc_hdr": ("J12", ["Order", "Matnr", "Quantity"], ["Order", "StatusShort"]),
    "j13_sop_pg": (
        "J13",
        ["ProductGroup", "Period", "TargetQuantity"],
        ["ProductGroup", "Description"],
    ),
}

for _name, (_edge, _many, _one) in EDGE_QUERIES.items():
    query(lambda m, e=_edge, a=_many, b=_one: _flat(join_edge(m, e, a, b)), _name)


@query
def j14_widen(m):
    dims = ["COOIS_OrderHeaders.StatusShort", "MARA.MTART", "ProductGroup.Description"]
    return _flat(widen(m, CONFIRMATIONS, ["Order", "WorkCenter", "YieldQuantity"], dims))


@query
def j15_orphans(m):
    """Keys of some dimension rows altered, so that they go missing."""
    columns: dict[str, set[str]] = {}
    for e in EDGES:
        columns.setdefault(e.many, set()).add(e.many_key)
        columns.setdefault(e.one, set()).add(e.one_key)
    altered = {
        "MARA": ("MATNR", "MTART", F.col("MTART") != "FERT"),
        "WorkCenters": ("WorkCenter", "WERKS", F.col("WERKS") != "1000"),
        HEADERS: ("Order", "StatusShort", F.col("StatusShort") == "CLSD"),
    }
    frames = {t: m.table(t, *names) for t, names in columns.items() if t not in altered}
    for t, (key, name, wrong) in altered.items():
        value = F.when(wrong, F.concat(F.lit("?"), key)).otherwise(F.col(key))
        frames[t] = m.table(t, *columns[t], name).withColumn(key, value)
    return orphans(FrameMart(frames))


@query
def j16_waiting_orders(m):
    headers = m.table(HEADERS, "Order", "StatusShort", "FinishDate")
    return joins.waiting_orders(headers, m.table("CO24", "Order", "MissingPart"))


@query
def j17_clean_orders(m):
    headers = m.table(HEADERS, "Order", "SystemStatus", "Priority")
    return joins.clean_orders(headers, m.table("CO24", "Order", "MissingPart"))


@query
def j18_matdoc_type(m):
    moves = m.table("MATDOC", "Order", "Matnr", "MovementType", "Quantity")
    return joins.with_movement_type(moves, m.table("MovementTypes"))


@query
def j19_component_material(m):
    return joins.with_component(
        m.table("CO24", "Order", "Component", "ShortageQuantity"),
        m.table("MARA", "MATNR", "MTART", "ProductGroup"),
        m.table("D_Part", "MATNR", "CriticalPart", "ABC_Class"),
    )


@query
def j20_op_confirmation(m):
    return joins.with_confirmation(
        m.table(OPERATIONS, "Order", "Operation", "WorkCenter", "TargetQuantity"),
        m.table(CONFIRMATIONS, "Order", "Operation", "YieldQuantity", "DelayHours"),
    )


@query
def j21_stock_part(m):
    return joins.with_stock(
        m.table("MARC", "MATNR", "WERKS", "DISPO"),
        m.table("tmp_PartStockV1", "Part", "WERKS", "Stock", "SnapshotTime"),
    )


@query
def j22_hierarchy(m):
    return joins.ancestors(m.table("ProductHierarchy")).select(
        "node", "ancestor", "distance"
    )


@query
def j23_order_controller(m):
    return joins.with_controller(
        m.table(HEADERS, "Order", "Material", "WERKS"),
        m.table("MARC", "MATNR", "WERKS", "DISPO"),
        m.table("MRP_Cntr"),
    )


# ---- measures ---------------------------------------------------------------------------

# Query → measure, group columns.
MEASURE_QUERIES = {
    "m01_order_count": ("Order Count", ["ProductGroup.ProductGroup"]),
    "m02_released_load": ("Released Order Load", ["COOIS_OrderHeaders.Priority"]),
    "m03_backlog": ("Backlog Order Count", ["COOIS_OrderHeaders.StatusShort"]),
    "m04_order_qty": ("Total Order Quantity", ["MARA.MTART"]),
    "m05_delivered_qty": ("Total Delivered Quantity", ["COOIS_OrderHeaders.StatusShort"]),
    "m06_op_count": ("Operation Count", ["WorkCenters.WERKS"]),
    "m07_bottleneck_ops": (
        "Bottleneck Operation Count (Laser Balancing)",
        ["COOIS_OrderHeaders.StatusShort"],
    ),
    "m08_yield": ("Total Yield", ["ProductGroup.Description"]),
    "m09_scrap": ("Total Scrap", ["WorkCenters.WorkCenter"]),
    "m10_rework": ("Total Rework", ["COOIS_OrderHeaders.Priority", "WorkCenters.WERKS"]),
    "m11_scrap_rate": ("Scrap Rate", ["ProductGroup.ProductGroup"]),
    "m12_avg_delay": ("Avg Posting Delay Hours", ["WorkCenters.WERKS"]),
    "m13_missing_parts": ("Missing Part Count", ["COOIS_OrderHeaders.StatusShort"]),
    "m14_shortage_qty": ("Total Shortage Quantity", ["MARA.MTART"]),
    "m15_sop_target": ("Total Target Quantity", ["ProductGroup.ProductGroup"]),
    "m16_sop_actual": ("Total SOP Actual Quantity", ["SOP_Targets.Period"]),
    "m17_sop_deviation": ("SOP Deviation", ["ProductGroup.Description", "SOP_Targets.WERKS"]),
}

for _name, (_measure, _by) in MEASURE_QUERIES.items():
    query(lambda m, n=_measure, b=_by: evaluate(m, [measure(n)], b), _name)


@query
def i01_implicit_sum(m):
    def of(table: str) -> DataFrame:
        columns = S.summable_columns(table)
        sums = totals.implicit_sum(m.table(table, *columns), table)
        return sums.unpivot([], columns, "column", "total").select(
            F.lit(table).alias("table"), "column", "total"
        )

    return reduce(DataFrame.unionByName, [of(t) for t in S.TABLES if S.summable_columns(t)])


@query
def i02_compose(m):
    loss = Measure.compose(
        "Loss Rate",
        lambda v: F.try_divide(v[0] + v[1], v[0] + v[1] + v[2]),
        measure("Total Scrap"),
        measure("Total Rework"),
        measure("Total Yield"),
    )
    return evaluate(m, [loss, measure("Scrap Rate")], ["WorkCenters.WorkCenter"])


@query
def i03_filtered_measure(m):
    def released():
        return F.col("StatusShort") == "REL"

    orders = measure("Order Count")
    narrowed = orders.where(released, ["StatusShort"]).named("Released Here")
    replaced = orders.where(released, ["StatusShort"], override=True).named("Released Anywhere")
    return evaluate(
        m,
        [orders, narrowed, replaced],
        ["COOIS_OrderHeaders.StatusShort", "COOIS_OrderHeaders.Priority"],
        {"COOIS_OrderHeaders.StatusShort": lambda c: c.isin("REL", "PCNF", "CNF")},
    )


@query
def i04_measure_by_dims(m):
    return evaluate(
        m,
        [measure(n) for n in ("Total Yield", "Scrap Rate", "Avg Posting Delay Hours")],
        ["ProductGroup.ProductGroup", "WorkCenters.Bottleneck"],
        {
            "COOIS_OrderHeaders.StatusShort": lambda c: c != "CRTD",
            "COOIS_Confirmations.DelayHours": lambda c: c < 48,
        },
    )


@query
def i05_drill_across(m):
    names = (
        "Order Count",
        "Released Order Load",
        "Missing Part Count",
        "Total Shortage Quantity",
        "SOP Deviation",
        "Scrap Rate",
    )
    return evaluate(m, [measure(n) for n in names], ["ProductGroup.ProductGroup"])


@query
def i06_conf_all(m):
    columns = [c for c in totals.OUTPUT.values()]
    return totals.output_totals(m.table(CONFIRMATIONS, "WorkCenter", *columns), ["WorkCenter"])


@query
def i07_stock_total(m):
    return totals.stock_total(m.table("MARD", "MATNR", "WERKS", "LABST"))


@query
def i08_distinct_orders(m):
    """Distinct released orders with an unfinished operation, by what the order's material and the
    centre say: a distinct count of a fact by dimensions on two paths."""
    waiting = distinct_of("Orders Waiting", OPERATIONS, "Order").where(
        lambda: F.col("StatusShort") != "CNF", ["StatusShort"]
    )
    return evaluate(
        m,
        [waiting, distinct_of("Materials", OPERATIONS, "Material"), measure("Operation Count")],
        ["ProductGroup.ProductGroup", "WorkCenters.WERKS"],
        {"COOIS_OrderHeaders.SystemStatus": lambda c: c.contains("REL")},
    )


@query
def i09_distinct_drill(m):
    """Distinct counts of three facts and a sum beside one another, and a ratio with one of them."""
    confirmed = distinct_of("Orders Confirmed", CONFIRMATIONS, "Order")
    return evaluate(
        m,
        [
            confirmed,
            Measure.compose(
                "Yield Per Order", lambda v: F.try_divide(v[0], v[1]), measure("Total Yield"), confirmed
            ),
            distinct_of("Components Missing", "CO24", "Component").where(
                lambda: F.col("MissingPart") == 1, ["MissingPart"]
            ),
            distinct_of("Materials Ordered", HEADERS, "Material"),
        ],
        ["MARA.MTART", "COOIS_OrderHeaders.Priority"],
    )


@query
def i10_levels(m):
    """Six measures of three facts at three levels, a distinct count among them."""
    names = ("Order Count", "Released Order Load", "Scrap Rate", "Total Yield", "Missing Part Count")
    return evaluate_levels(
        m,
        [*map(measure, names), distinct_of("Orders Confirmed", CONFIRMATIONS, "Order")],
        ["ProductGroup.ProductGroup", "COOIS_OrderHeaders.Priority"],
    )


@query
def i11_distinct_rollup(m):
    """Distinct confirmed orders a plant and month, from bitmaps kept by centre and day."""
    rows = m.table(CONFIRMATIONS, "Order", "WorkCenter", "ActualEnd")
    numbers = sketches.numbered(m.table(HEADERS, "Order"), "Order")
    daily = sketches.value_bitmaps(
        rows.join(numbers, "Order").withColumn("day", F.to_date("ActualEnd")), ["WorkCenter", "day"]
    )
    centers = m.table("WorkCenters", "WorkCenter", "WERKS")
    monthly = daily.join(centers, "WorkCenter", "left").withColumn("Period", D.period("day"))
    by = ["WERKS", "Period"]
    return sketches.bitmap_counts(sketches.merge_bitmaps(monthly, by), by, "orders")


@query
def i12_case_blind(m):
    """Measures where half of the orders and materials have their codes in small letters, as if all
    were written alike."""
    odd = F.crc32("Order") % 2 == 1
    headers = m.table(HEADERS, "Order", "Material", "StatusShort", "SystemStatus").withColumns(
        {c: F.when(odd, F.lower(c)).otherwise(F.col(c)) for c in ("StatusShort", "SystemStatus")}
    )
    materials = m.table("MARA", "MATNR", "MTART").withColumn(
        "MTART", F.when(F.crc32("MATNR") % 2 == 1, F.lower("MTART")).otherwise(F.col("MTART"))
    )
    found = evaluate(
        CaseBlindMart(FrameMart({HEADERS: headers, "MARA": materials})),
        [measure("Order Count"), measure("Released Order Load"), distinct_of("Statuses", HEADERS, "SystemStatus")],
        ["MARA.MTART", "COOIS_OrderHeaders.StatusShort"],
        {"COOIS_OrderHeaders.StatusShort": lambda c: c.isin("rel", "Pcnf", "CNF")},
    )
    texts = [F.upper(F.col(c).cast("string")).alias(c) for c in ("MTART", "StatusShort")]
    return found.select(*texts, *found.columns[2:])


# ---- questions and analyses -------------------------------------------------------------


@query
def q1_released_and_backlog(m):
    headers = m.table(HEADERS, "StatusShort", "SystemStatus", "Backlog")
    return A.released_and_backlog(headers, ["StatusShort"])


@query
def q2_bottleneck_ops(m):
    return A.bottleneck_operations(
        m.table(OPERATIONS, "WorkCenter", "BottleneckOperation"),
        m.table("WorkCenters", "WorkCenter", "Bottleneck"),
    )


@query
def q3_waiting_orders(m):
    return A.waiting_on_parts(
        m.table(HEADERS, "Order"), m.table("CO24", "Order", "MissingPart", "ShortageQuantity")
    ).withColumn("subtotal_level", F.col("subtotal_level").cast("bigint"))


@query
def q4_top_scrap_group(m):
    return A.top_scrap_group(m)


@query
def q5_posting_delay(m):
    confirmations = m.table(CONFIRMATIONS, "WorkCenter", "DelayHours")
    return A.posting_delay(confirmations, ["WorkCenter"])


@query
def a01_order_load(m):
    by = ["WERKS", "ProductGroup", "Priority"]
    headers = m.table(HEADERS, *by, "SystemStatus", "OrderQuantity", "DeliveredQuantity")
    return A.order_load(headers, by)


@query
def a02_material_buffer(m):
    return A.material_buffer(
        m.table(
            OPERATIONS, "Order", "WorkCenter", "StatusShort", "TargetQuantity", "ActualQuantity"
        ),
        m.table(HEADERS, "Order", "SystemStatus"),
    )


@query
def a03_utilization(m):
    return A.utilization(
        m.table(OPERATIONS, "WorkCenter", "StatusShort", "SetupTime", "MachineTime"),
        m.table("WorkCenters", "WorkCenter", "TheoreticalCapacityHrDay"),
    )


@query
def a04_actual_utilization(m):
    return A.actual_utilization(
        m.table(CONFIRMATIONS, "WorkCenter", "ActualEnd", "ActualMachineTime"),
        m.table("WorkCenters", "WorkCenter", "TheoreticalCapacityHrDay"),
    )


@query
def a05_throughput_compare(m):
    return A.throughput_compare(
        m.table("MATDOC", "Order", "MovementType", "Quantity"),
        m.table(CONFIRMATIONS, "Order", "Operation", "YieldQuantity"),
    )


@query
def a06_precedence(m):
    return A.delivered_by_precedence(
        m.table("MATDOC", "Order", "MovementType", "Quantity"),
        m.table(CONFIRMATIONS, "Order", "Operation", "YieldQuantity"),
        m.table(HEADERS, "Order", "DeliveredQuantity"),
        m.table(OPERATIONS, "Order", "Operation", "ActualQuantity"),
    )


@query
def a07_delay_profile(m):
    return A.delay_profile(m.table(CONFIRMATIONS, "WorkCenter", "DelayHours"), ["WorkCenter"])


@query
def a08_queue_time(m):
    return A.queue_time(
        m.table(OPERATIONS, "Order", "Operation", "StartDate", "FinishDate"),
        m.table(CONFIRMATIONS, "Order", "Operation", "ActualEnd", "ActualMachineTime"),
    )


@query
def a09_prioritize(m):
    columns = ["Order", "SystemStatus", "StatusShort", "SOP_Relevant", "Backlog", "Priority"]
    return A.prioritize(
        m.table(HEADERS, *columns), m.table("CO24", "Order", "MissingPart", "ShortageQuantity"), 50
    )


@query
def a10_bottleneck_board(m):
    return A.bottleneck_board(m)


@query
def a11_output(m):
    by = ["WERKS", "WorkCenter"]
    confirmations = m.table(CONFIRMATIONS, *by, *totals.OUTPUT.values())
    return A.output_by(confirmations, by)


@query
def a12_sop(m):
    return A.sop_attainment(m.table("SOP_Targets"), ["ProductGroup", "WERKS"], cube=True)


@query
def a13_critical_shortage(m):
    return A.critical_shortage(
        m.table("CO24", "Component", "MissingPart", "ShortageQuantity"),
        m.table("D_Part", "MATNR", "ABC_Class", "XYZ_Class", "CriticalPart"),
    )


@query
def a14_stock_cover(m):
    return A.stock_cover(
        m.table("CO24", "Component", "WERKS", "MissingPart", "ShortageQuantity"),
        m.table("MARD", "MATNR", "WERKS", "LABST"),
    )


@query
def a15_status_mix(m):
    return A.status_mix(m.table(HEADERS, "StatusShort"))


@query
def a16_hierarchy_rollup(m):
    return A.by_hierarchy(m, [measure("Total Yield"), measure("Scrap Rate")], 2)


@query
def a17_throughput_trend(m):
    return A.throughput_time(
        m.table(HEADERS, "Order", "StartDate"), m.table(CONFIRMATIONS, "Order", "ActualEnd")
    )


@query
def a18_consumption(m):
    return A.consumption(
        m.table("MATDOC", "Order", "Matnr", "MovementType", "Quantity"), m.table("MovementTypes")
    )


@query
def a19_idle_time(m):
    return idle_time(m.table(CONFIRMATIONS, "WorkCenter", "ActualEnd", "ActualMachineTime"))


@query
def a20_delay_sketch(m):
    """Percentiles of delay by month, merged from sketches by centre and day: how many of them are
    further than 1.5 % of the rows from their rank."""
    rows = m.table(CONFIRMATIONS, "WorkCenter", "ActualEnd", "DelayHours")
    rows = rows.withColumns({"day": F.to_date("ActualEnd"), "Period": D.period("ActualEnd")})
    daily = sketches.quantile_sketches(rows, ["WorkCenter", "day", "Period"], "DelayHours")
    monthly = sketches.merge_sketches(daily, ["Period"])
    errors = sketches.quantile_errors(rows, monthly, ["Period"], "DelayHours", (50, 90, 99))
    off = [F.when(F.col(f"off_{p}") > 0.015, 1).otherwise(0) for p in (50, 90, 99)]
    return errors.select("Period", F.col("rows").alias("postings"), reduce(lambda a, b: a + b, off).alias("off"))


# ---- quality checks ---------------------------------------------------------------------
# Valid data has no violations, so each check runs on a table with one column made wrong.


@query
def k01_shortage(m):
    """Issued quantity forgotten."""
    lines = m.table(
        "CO24", "Order", "Component", "Reqmnt_qty", "Comm_qty", "Qty_issued", "ShortageQuantity",
        "MissingPart",
    )
    wrong = D.shortage("Reqmnt_qty", "Comm_qty", F.lit(0))
    return quality.check_k1(lines.withColumn("ShortageQuantity", wrong)).select(
        "Order", "Component", "ShortageQuantity", "ExpectedShortage"
    )


@query
def k02_delay(m):
    """Half-hour delays booked as whole hours."""
    columns = ["Order", "WorkCenter", "ActualEnd", "SAP_PostingTime", "DelayHours"]
    rows = m.table(CONFIRMATIONS, *columns)
    return quality.check_k2(rows.withColumn("DelayHours", F.ceil("DelayHours").cast("double")))


@query
def k03_backlog(m):
    """Flags taken at another date."""
    headers = m.table(HEADERS, "Order", "StatusShort", "FinishDate", "Backlog")
    return quality.check_k3(headers, "1999-01-01").select("Order", "Backlog", "ExpectedBacklog")


@query
def k04_status(m):
    """Closed orders without their last status."""
    headers = m.table(HEADERS, "Order", "StatusShort", "SystemStatus")
    cut = F.regexp_replace("SystemStatus", " CLSD$", "")
    return quality.check_k4(headers.withColumn("SystemStatus", cut))


@query
def k05_delivered(m):
    """One piece too many delivered."""
    headers = m.table(HEADERS, "Order", "StatusShort", "OrderQuantity", "DeliveredQuantity")
    return quality.check_k5(headers.withColumn("DeliveredQuantity", F.col("DeliveredQuantity") + 1))


@query
def k06_capacity(m):
    """Utilisation not applied."""
    columns = ["WorkCenter", "NGRAD", "EINZH", "AZNOR", "TheoreticalCapacityHrDay"]
    centers = m.table("WorkCenters", *columns)
    wrong = F.col("EINZH") * F.col("AZNOR")
    return quality.check_k6(centers.withColumn("TheoreticalCapacityHrDay", wrong)).select(
        "WorkCenter", "TheoreticalCapacityHrDay", "ExpectedCapacity"
    )


@query
def k07_sop(m):
    """Deviation cut to whole pieces."""
    keys = ["ProductGroup", "WERKS", "Period"]
    sop = m.table("SOP_Targets", *keys, "TargetQuantity", "ActualQuantity", "Deviation")
    wrong = F.col("Deviation").cast("bigint").cast("double")
    return quality.check_k7(sop.withColumn("Deviation", wrong)).select(
        *keys, "Deviation", "ExpectedDeviation"
    )


@query
def k08_dates(m):
    """Start moved two days later."""
    headers = m.table(HEADERS, "Order", "CreationDate", "StartDate", "FinishDate")
    return quality.check_k8(
        headers.withColumn("StartDate", F.date_add("StartDate", 2)), (1, 5), (3, 20)
    )


@query
def k09_sequence(m):
    operations = m.table(OPERATIONS, "Order", "Operation", "StatusShort")
    return quality.check_k9(operations)


@query
def k10_confirmed_only(m):
    """Partial confirmations not allowed."""
    return quality.check_k10(
        m.table(OPERATIONS, "Order", "Operation", "StatusShort"),
        m.table(CONFIRMATIONS, "Order", "Operation"),
        allowed=("CNF",),
    )


@query
def k11_keys(m):
    """Line items by order and line number, which repeat, beside all mart keys."""
    repeated = quality.duplicate_keys(
        m.source("lineitem"), "lineitem", ["l_orderkey", "l_linenumber"]
    )
    return quality.check_k11(m).unionByName(repeated)


@query
def k12_stock(m):
    """Stock of the second location counted as none."""
    mard = m.table("MARD", "MATNR", "WERKS", "LGORT", "LABST").withColumn(
        "LABST", F.when(F.col("LGORT") == "0001", F.col("LABST")).otherwise(0.0)
    )
    return quality.check_k12(mard, m.table("tmp_PartStockV1", "Part", "WERKS", "Stock"))


@query
def k13_checks_on_load(m):
    """Rows that break a rule, counted in the pass that stores the table; one column is made wrong."""
    lines = m.table("CO24").withColumn("ShortageQuantity", F.ceil("ShortageQuantity").cast("double"))
    expected = D.shortage("Reqmnt_qty", "Comm_qty", F.lit(0))
    checks = [
        layout.Check("shortage", F.col("ShortageQuantity") != expected),
        layout.Check("component", F.col("Component").isNull(), limit=0),
        layout.Check("negative", F.col("Reqmnt_qty") < 0, limit=0),
    ]
    found = layout.save_checked(lines, storage.new_root(m.spark), "CO24", checks)
    return m.spark.createDataFrame(list(found.items()), "check string, rows bigint")
