"""Order and line-item tables seen as mart tables.

Every mart table is a lazy DataFrame over the given tables. A join is added only when one of
the requested columns needs it, so counting orders by status reads one table and shuffles no
rows. Amounts are computed in whole cents, tenths or hundredths and divided once at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forgemart import fixed_values as fixed
from forgemart.functions import derivations as D
from forgemart.operators.generate import expand_locations
from forgemart.operators.sequences import key_bins, numbered_with, row_numbers
from forgemart.operators.skew import lookup
from forgemart.sources import schema as S
from forgemart.sources import storage
from forgemart.sources.steps import written

AS_OF = "2000-01-01"

# Product groups of the bound data, and the group whose routing and controllers each one uses.
GROUP_ROLE = {
    "ECONOMY": "PG50",
    "LARGE": "PG40",
    "MEDIUM": "PG30",
    "PROMO": "PG10",
    "SMALL": "PG20",
    "STANDARD": "PG20",
}
FINISHED_GROUPS = ("LARGE", "PROMO")
BOUND_ROUTINGS = {group: fixed.ROUTINGS[role] for group, role in GROUP_ROLE.items()}
BOUND_CONTROLLERS = {
    (plant, group): fixed.MRP_CONTROLLERS[plant, role]
    for plant in fixed.PLANTS
    for group, role in GROUP_ROLE.items()
}
BOUND_NODES = {group: f"RE-{group}" for group in GROUP_ROLE}
ROLES = tuple(fixed.ROLE_TEXT)

LINE_ORDER = (
    "l_linenumber",
    "l_shipdate",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
)

# Minutes from an operation's end to its posting, by its part.
DELAY_MINUTES = (6, 18, 45, 90, 150, 300, 720, 2160)
LINE_SPREAD = ("l_partkey", "l_suppkey")  # deal out line items without an order
LINES_PER_BIN = 1_000  # line numbers of an order that are numbered in one task

# Types of the given tables that are read, so that opening them needs no look into their files.
SOURCES = {
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
        " p_retailprice double"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}

MRP_ROWS = [
    ("101", "1000", "Controller 101", "Rotating parts", "c101@example.org"),
    ("102", "1000", "Controller 102", "Housings and shields", "c102@example.org"),
    ("103", "1000", "Controller 103", "Motors", "c103@example.org"),
    ("201", "2000", "Controller 201", "Whole plant 2000", "c201@example.org"),
]
ACTIVITY_ROWS = [
    ("MACH", "Hours of the machine", "HR"),
    ("LABR", "Hours of the operator", "HR"),
    ("SETUP", "Hours of the set-up", "HR"),
]
MOVEMENT_ROWS = [
    (code, f"Movement {code}", sign, direction)
    for code, (sign, direction) in fixed.MOVEMENT_TYPES.items()
]


def small_table(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    """A handful of constant rows; the Arrow path makes them a local relation of known size."""
    columns = S.column_names(name)
    frame = pa.table({c: list(values) for c, values in zip(columns, zip(*rows), strict=True)})
    return spark.createDataFrame(frame)


def plant_of(partkey: Column) -> Column:
    return F.when(partkey % 4 == 0, "2000").otherwise("1000")


def center_key(suppkey: Column) -> Column:
    return F.concat(F.lit("WC"), D.pad_key(suppkey, 8))


def _percent(c: str) -> Column:
    return F.rint(F.col(c) * 100).cast("bigint")


def _order_key(c: str) -> Column:
    return D.pad_key(c, fixed.ORDER_WIDTH)


def _hundredths() -> Column:
    """Quantities have two decimals."""
    return F.rint(F.col("l_quantity") * 100).cast("bigint")


def _quantity() -> Column:
    return _hundredths() / 100


def _machine_hundredths() -> Column:
    return F.expr("(CAST(rint(l_extendedprice * 100) AS BIGINT) + 5000) div 10000")


def _labor_hours() -> Column:
    return F.floor(_machine_hundredths() * 3 / 5) / 100


def _setup_hours() -> Column:
    return _percent("l_tax") * 10 / 100


def _role() -> Column:
    return F.try_element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("l_linenumber"))


def _ship_day() -> Column:
    return F.to_date("l_shipdate")


def _material_type(group: str) -> Column:
    return F.when(F.col(group).isin(*FINISHED_GROUPS), "FERT").otherwise("HALB")


def _line_number(width: int) -> Column:
    """Document number of a line item: its order followed by its position. A position of more
    than four digits is set off by a dash, so that no two line items share a number."""
    place = F.when(F.col("op_seq") < 10_000, D.pad_key("op_seq", 4)).otherwise(
        F.concat(F.lit("-"), F.col("op_seq").cast("string"))
    )
    return D.pad_key(F.concat(F.col("l_orderkey").cast("string"), place), width)


def _order_status() -> Column:
    return F.expr(
        """CASE o_orderstatus
             WHEN 'O' THEN if(startswith(o_orderpriority, '5'), 'CRTD', 'REL')
             WHEN 'P' THEN 'PCNF'
             ELSE CASE substring(o_orderpriority, 1, 1)
               WHEN '1' THEN 'CNF' WHEN '2' THEN 'DLV' WHEN '3' THEN 'TECO' ELSE 'CLSD' END
           END"""
    )


def _priority() -> Column:
    return F.expr("CAST(substring(o_orderpriority, 1, 1) AS INT)")


def _start_date() -> Column:
    return F.date_add(F.to_date("o_orderdate"), _priority())


def _finish_date() -> Column:
    return F.date_add(_start_date(), F.expr("CAST(o_orderkey % 18 + 3 AS INT)"))


def _order_quantity() -> Column:
    return F.col("order_quantity").cast("double")


def _delay() -> Column:
    return _delay_minutes() / 60


def _delay_minutes() -> Column:
    return F.array(*[F.lit(x) for x in DELAY_MINUTES])[F.col("l_partkey") % len(DELAY_MINUTES)]


def _actual_end() -> Column:
    return F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber") * 3)


def _committed() -> Column:
    """Requirement less five times the discount, to tenths."""
    share = F.lit(100) - _percent("l_discount") * 5
    return F.floor((_hundredths() * share + 500) / 1000) / 10


def _issued() -> Column:
    """The tax share of the requirement, to tenths."""
    return F.floor((_hundredths() * _percent("l_tax") + 500) / 1000) / 10


def _gap() -> Column:
    return D.shortage(_quantity(), _committed(), _issued())


Columns = dict[str, Callable[[], Column]]


def _plain(df: DataFrame) -> tuple[DataFrame, Columns]:
    return df, {c: lambda c=c: F.col(c) for c in df.columns}


def _line_bin() -> Column:
    return F.floor(F.col("l_linenumber") / LINES_PER_BIN)


class BoundMart:
    """Mart tables over the tables in ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._build: dict[str, Callable[[set[str]], tuple[DataFrame, Columns]]] = {
            "ProductGroup": self._product_group,
            "ProductHierarchy": self._product_hierarchy,
            "MRP_Cntr": lambda _: _plain(small_table(spark, "MRP_Cntr", MRP_ROWS)),
            "ActivityTypes": lambda _: _plain(small_table(spark, "ActivityTypes", ACTIVITY_ROWS)),
            "MovementTypes": lambda _: _plain(small_table(spark, "MovementTypes", MOVEMENT_ROWS)),
            "WorkCenters": self._work_centers,
            "MARA": self._mara,
            "MARC": self._marc,
            "MARD": self._mard,
            "D_Part": self._d_part,
            "tmp_PartStockV1": self._part_stock,
            "COOIS_OrderHeaders": self._order_headers,
            "COOIS_OrderOperations": self._order_operations,
            "COOIS_Confirmations": self._confirmations,
            "CO24": self._missing_parts,
            "MATDOC": self._movements,
            "SOP_Targets": self._sop_targets,
        }

    def table(self, name: str, *columns: str) -> DataFrame:
        wanted = columns or tuple(S.column_names(name))
        types = {field.name: field.dataType for field in S.schema(name)}
        df, build = self._build[name](set(wanted))
        return df.select(*[build[c]().cast(types[c]).alias(c) for c in wanted])

    def source(self, name: str) -> DataFrame:
        return self.spark.read.schema(SOURCES[name]).parquet(f"{self.root}/{name}.parquet")

    def kept(self) -> KeptMart:
        """The same tables, for steps that store several of them."""
        return KeptMart(self.spark, self.root)

    def dealt(self, database: str, buckets: int) -> DealtMart:
        """The same tables, for steps that store several of them in buckets by order."""
        return DealtMart(self.spark, self.root, database, buckets)

    # ---- master data --------------------------------------------------------------------

    def _groups(self) -> DataFrame:
        return self.source("part").select(F.col("p_type").alias("ProductGroup")).distinct()

    def _product_group(self, _: set[str]) -> tuple[DataFrame, Columns]:
        return _plain(self._groups().withColumn("Description", F.initcap("ProductGroup")))

    def _product_hierarchy(self, _: set[str]) -> tuple[DataFrame, Columns]:
        """Root, one node per material type, one node per product group: every group yields the
        path to its own node, and repeated nodes fold."""
        kind = _material_type("ProductGroup")
        node = F.concat(F.lit("RE-"), F.col("ProductGroup"))
        parent = F.concat(F.lit("RE-"), kind)

        def row(key: Column, text: Column, level: int, above: Column) -> Column:
            return F.struct(
                key.alias("ProductHierarchy"),
                text.alias("Description"),
                F.lit(level).alias("Level"),
                above.cast("string").alias("Parent"),
            )

        steps = F.array(
            row(F.lit("RE-ALL"), F.lit("All"), 1, F.lit(None)),
            row(parent, kind, 2, F.lit("RE-ALL")),
            row(node, F.initcap("ProductGroup"), 3, parent),
        )
        return _plain(self._groups().select(F.inline(steps)).distinct())

    def _mara(self, _: set[str]) -> tuple[DataFrame, Columns]:
        return self.source("part"), {
            "MATNR": lambda: D.pad_key("p_partkey"),
            "MTART": lambda: _material_type("p_type"),
            "MATKL": lambda: F.col("p_brand"),
            "MEINS": lambda: F.lit("PC"),
            "NTGEW": lambda: F.col("p_size"),
            "GEWEI": lambda: F.lit("KG"),
            "PRDHA": lambda: D.hierarchy_key("p_type", BOUND_NODES),
            "ProductGroup": lambda: F.col("p_type"),
            "MAKTX": lambda: F.col("p_name"),
        }

    def _marc(self, _: set[str]) -> tuple[DataFrame, Columns]:
        key = F.col("p_partkey")
        return self.source("part"), {
            "MATNR": lambda: D.pad_key(key),
            "WERKS": lambda: plant_of(key),
            "DISPO": lambda: D.mrp_controller(plant_of(key), "p_type", BOUND_CONTROLLERS),
            "BESKZ": lambda: D.procurement(_material_type("p_type")),
            "FEVOR": lambda: F.lit("PP01"),
            "DZEIT": lambda: key % 6 + 2,
            "InHouseProductionTimeDays": lambda: (F.col("p_size") % 30 + 3) / 10,
        }

    def _mard(self, _: set[str]) -> tuple[DataFrame, Columns]:
        key = F.col("p_partkey")
        factor = F.when(F.col("LGORT") == fixed.STORAGE_LOCATIONS[0], 7).otherwise(11)
        return expand_locations(self.source("part").select("p_partkey")), {
            "MATNR": lambda: D.pad_key(key),
            "WERKS": lambda: plant_of(key),
            "LGORT": lambda: F.col("LGORT"),
            "LABST": lambda: key * factor % 250,
            "INSME": lambda: (key + factor) % 9,
            "StockDate": lambda: F.date_sub(
                F.lit(AS_OF).cast("date"), (key % 40 + 1).cast("int")
            ),
        }

    def _d_part(self, _: set[str]) -> tuple[DataFrame, Columns]:
        size = F.col("p_size")
        return self.source("part"), {
            "MATNR": lambda: D.pad_key("p_partkey"),
            "ProductGroup": lambda: F.col("p_type"),
            "Description": lambda: F.col("p_name"),
            "ABC_Class": lambda: F.when(size <= 25, "A").when(size <= 40, "B").otherwise("C"),
            "XYZ_Class": lambda: F.array(*[F.lit(x) for x in "XYZ"])[size % 3],
            "CriticalPart": lambda: F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0),
            "StandardPrice": lambda: F.col("p_retailprice"),
        }

    def _part_stock(self, _: set[str]) -> tuple[DataFrame, Columns]:
        key = F.col("p_partkey")
        clock = F.lit(f"{AS_OF} 07:30:00").cast("timestamp_ntz")
        return self.source("part"), {
            "Part": lambda: D.pad_key(key),
            "WERKS": lambda: plant_of(key),
            "Stock": lambda: key * 7 % 250 + key * 11 % 250,
            "Unit": lambda: F.lit("PC"),
            "SnapshotTime": lambda: clock - F.make_dt_interval(hours=(key % 12 + 1).cast("int")),
        }

    def _work_centers(self, _: set[str]) -> tuple[DataFrame, Columns]:
        key = F.col("s_suppkey")

        def percent() -> Column:
            return key % 31 + 60

        def units() -> Column:
            return key % 3 + 1

        return self.source("supplier"), {
            "WorkCenter": lambda: center_key(key),
            "WERKS": lambda: F.when(F.col("s_nationkey") % 2 == 0, "1000").otherwise("2000"),
            "Description": lambda: F.col("s_name"),
            "NGRAD": percent,
            "EINZH": lambda: F.lit(8.0),
            "AZNOR": units,
            "CapacityCategory": lambda: F.lit("001"),
            "Bottleneck": lambda: F.when(key % 10 == 0, 1).otherwise(0),
            "TheoreticalCapacityHrDay": lambda: D.capacity(percent(), F.lit(8.0), units()),
        }

    # ---- orders -------------------------------------------------------------------------

    def _order_totals(self) -> DataFrame:
        """Material and quantity of each order; unique by construction, so an unused join to
        it is dropped by the optimizer."""
        return (
            self.source("lineitem")
            .groupBy(F.col("l_orderkey").alias("total_order"))
            .agg(F.min("l_partkey").alias("order_part"), (F.sum(_hundredths()) / 100).alias("order_quantity"))
        )

    def _order_of(self, key: str) -> Column:
        return _order_key(key)

    def _with_order_part(
        self, df: DataFrame, key: str, wanted: set[str], by: Sequence[str]
    ) -> DataFrame:
        """Add the order's material number and, where needed, its part row."""
        df = lookup(df, self._order_totals(), key, "total_order", by)
        return self._with_part(df, wanted)

    def _with_part(self, df: DataFrame, wanted: set[str]) -> DataFrame:
        if wanted & {"ProductGroup", "MaterialText", "SOP_Relevant"}:
            part = self.source("part").select("p_partkey", "p_name", "p_type")
            df = df.join(part, F.col("order_part") == F.col("p_partkey"), "left")
        return df

    def _order_headers(self, wanted: set[str]) -> tuple[DataFrame, Columns]:
        relevant = F.col("o_orderkey") % 10 < 7
        own: Columns = {
            "Order": lambda: self._order_of("o_orderkey"),
            "OrderType": lambda: F.lit("PP01"),
            "Unit": lambda: F.lit("PC"),
            "StatusShort": _order_status,
            "SystemStatus": lambda: D.system_status(_order_status()),
            "Priority": _priority,
            "Backlog": lambda: D.backlog_flag(_order_status(), _finish_date(), AS_OF),
            "CreationDate": lambda: F.to_date("o_orderdate"),
            "StartDate": _start_date,
            "FinishDate": _finish_date,
        }
        joined: Columns = {
            "Material": lambda: D.pad_key("order_part"),
            "WERKS": lambda: plant_of(F.col("order_part")),
            "OrderQuantity": _order_quantity,
            "DeliveredQuantity": lambda: D.expected_delivered(
                _order_status(), _order_quantity(), 0.5
            ),
            "MaterialText": lambda: F.col("p_name"),
            "ProductGroup": lambda: F.col("p_type"),
            "SOP_Relevant": lambda: F.when(
                F.col("p_type").isin(*FINISHED_GROUPS) & relevant, 1
            ).otherwise(0),
        }
        df = self.source("orders")
        if wanted & set(joined):
            df = self._with_order_part(df, "o_orderkey", wanted, ["o_custkey"])
        return df, own | joined

    # ---- line-item facts ----------------------------------------------------------------

    def numbered_lines(self) -> DataFrame:
        """Line items with their position 1, 2, 3 … inside the order."""
        return row_numbers(self.source("lineitem"), "l_orderkey", LINE_ORDER, _line_bin(), "op_seq")

    def _lines(self, wanted: set[str], numbered: set[str], by_order: set[str]) -> DataFrame:
        df = self.numbered_lines() if wanted & numbered else self.source("lineitem")
        if wanted & by_order:
            df = self._with_order_part(df, "l_orderkey", wanted, LINE_SPREAD)
        return df

    def _created(self) -> DataFrame:
        """Which orders are only created. Grouping by the key costs no shuffle beyond the one that
        the join needs, and shows the optimizer that the key is unique: where a filter makes the
        flag needless, the join is dropped."""
        created = F.max((_order_status() == "CRTD").cast("int")).alias("created")
        return self.source("orders").groupBy("o_orderkey").agg(created)

    def _with_created(self, df: DataFrame) -> DataFrame:
        return lookup(df, self._created(), "l_orderkey", "o_orderkey", LINE_SPREAD)

    def _order_operations(self, wanted: set[str]) -> tuple[DataFrame, Columns]:
        df = self._lines(wanted, {"Operation"}, {"Material", "ProductGroup", "WERKS"})
        if wanted & {"StatusShort", "SystemStatus"}:
            df = self._with_created(df)
        flag = F.col("l_returnflag")

        def status() -> Column:
            waiting = F.when(F.col("created") == 1, "CRTD").otherwise("REL")
            return F.when(flag == "R", "CNF").when(flag == "A", "PCNF").otherwise(waiting)

        def done() -> Column:
            half = F.floor(_quantity() / 2)
            return F.when(flag == "R", _quantity()).when(flag == "A", half).otherwise(0)

        def finish() -> Column:
            days = D.op_duration(_setup_hours(), _machine_hundredths() / 100)
            return F.date_add(_ship_day(), F.floor(days).cast("int"))

        return df, {
            "Order": lambda: self._order_of("l_orderkey"),
            "Operation": lambda: D.operation_no("op_seq"),
            "WorkCenter": lambda: center_key(F.col("l_suppkey")),
            "WERKS": lambda: plant_of(F.col("order_part")),
            "OperationText": lambda: D.decode(_role(), fixed.ROLE_TEXT),
            "StatusShort": status,
            "SystemStatus": lambda: D.system_status(status()),
            "ControlKey": lambda: F.lit("PP01"),
            "TargetQuantity": _quantity,
            "ActualQuantity": done,
            "SetupTime": _setup_hours,
            "MachineTime": lambda: _machine_hundredths() / 100,
            "LaborTime": _labor_hours,
            "StartDate": _ship_day,
            "FinishDate": finish,
            "Material": lambda: D.pad_key("order_part"),
            "ProductGroup": lambda: F.col("p_type"),
            "BottleneckOperation": lambda: D.bottleneck_flag(_role()),
        }

    def _confirmations(self, wanted: set[str]) -> tuple[DataFrame, Columns]:
        df = self._lines(wanted, {"Operation", "Confirmation"}, {"Material", "WERKS"})

        def good() -> Column:
            half = F.floor(_quantity() / 2)
            return F.when(F.col("l_returnflag") == "R", _quantity()).otherwise(half)

        def posting() -> Column:
            return _actual_end() + F.make_dt_interval(mins=_delay_minutes())

        return df.where(F.col("l_returnflag").isin("A", "R")), {
            "Confirmation": lambda: _line_number(fixed.CONFIRMATION_WIDTH),
            "Order": lambda: self._order_of("l_orderkey"),
            "Operation": lambda: D.operation_no("op_seq"),
            "WorkCenter": lambda: center_key(F.col("l_suppkey")),
            "WERKS": lambda: plant_of(F.col("order_part")),
            "YieldQuantity": good,
            "ScrapQuantity": lambda: F.floor(_quantity() * _percent("l_discount") / 100),
            "ReworkQuantity": lambda: F.floor(_quantity() * _percent("l_tax") / 100),
            "ActualMachineTime": lambda: _machine_hundredths() / 100,
            "ActualLaborTime": _labor_hours,
            "ActualEnd": _actual_end,
            "SAP_PostingTime": posting,
            "DelayHours": _delay,
            "Cancelled": lambda: F.lit(0),
            "Material": lambda: D.pad_key("order_part"),
        }

    def _with_names(self, df: DataFrame) -> DataFrame:
        names = self.source("part").select(
            F.col("p_partkey").alias("name_key"), F.col("p_name").alias("part_name")
        )
        return df.join(names, F.col("l_partkey") == F.col("name_key"), "left")

    def _missing_parts(self, wanted: set[str]) -> tuple[DataFrame, Columns]:
        df = self._lines(wanted, set(), {"WERKS"})
        if "ComponentText" in wanted:
            df = self._with_names(df)
        return df, {
            "Order": lambda: self._order_of("l_orderkey"),
            "Component": lambda: D.pad_key("l_partkey"),
            "WERKS": lambda: plant_of(F.col("order_part")),
            "LGORT": lambda: F.lit(fixed.STORAGE_LOCATIONS[0]),
            "Reqmnt_qty": _quantity,
            "Comm_qty": _committed,
            "Qty_issued": _issued,
            "ShortageQuantity": _gap,
            "MissingPart": lambda: D.missing_part(_gap()),
            "RequirementDate": _ship_day,
            "ComponentText": lambda: F.col("part_name"),
        }

    def _movements(self, wanted: set[str]) -> tuple[DataFrame, Columns]:
        df = self._lines(wanted, {"Mblnr"}, {"WERKS"})

        def kind() -> Column:
            return F.expr(
                """CASE l_returnflag || l_linestatus
                     WHEN 'RF' THEN '101' WHEN 'AF' THEN '261' WHEN 'NF' THEN '261'
                     WHEN 'NO' THEN '531' WHEN 'AO' THEN '311' WHEN 'RO' THEN '262' END"""
            )

        return df, {
            "Mblnr": lambda: _line_number(fixed.DOCUMENT_WIDTH),
            "Line": lambda: F.lit("0001"),
            "Matnr": lambda: D.pad_key("l_partkey"),
            "WERKS": lambda: plant_of(F.col("order_part")),
            "LGORT": lambda: F.lit(fixed.STORAGE_LOCATIONS[0]),
            "MovementType": kind,
            "Quantity": lambda: F.col("l_quantity"),
            "Unit": lambda: F.lit("PC"),
            "PostingDate": _ship_day,
            "DocumentDate": lambda: F.date_add(
                _ship_day(), (F.col("l_partkey") % 5 - 2).cast("int")
            ),
            "Order": lambda: self._order_of("l_orderkey"),
            "CostCenter": lambda: F.lit("CC100"),
        }

    def _sop_targets(self, _: set[str]) -> tuple[DataFrame, Columns]:
        """Line quantities per part and month first, which also folds a very frequent part,
        then the join to the part for its group."""
        month = F.month("l_shipdate")
        per_part = (
            self.source("lineitem")
            .groupBy("l_partkey", D.period("l_shipdate").alias("Period"))
            .agg(
                F.sum(_hundredths()).alias("actual"),
                F.sum(_hundredths() * (90 + 5 * (month % 5))).alias("target"),
            )
        )
        part = self.source("part").select("p_partkey", "p_type")
        df = (
            per_part.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
            .groupBy(
                F.col("p_type").alias("ProductGroup"),
                plant_of(F.col("l_partkey")).alias("WERKS"),
                "Period",
            )
            .agg(
                (F.sum("actual") / 100).alias("ActualQuantity"),
                (F.sum("target") / 10_000).alias("TargetQuantity"),
            )
        )
        same = {c: lambda c=c: F.col(c) for c in df.columns}
        return df, same | {
            "Description": lambda: F.initcap("ProductGroup"),
            "Deviation": lambda: D.sop_deviation("ActualQuantity", "TargetQuantity"),
            "Version": lambda: F.lit("V01"),
        }


def _without_names(parts: str) -> Column:
    return F.transform(parts, lambda part: F.struct(part["p_type"].alias("p_type")))


class KeptMart(BoundMart):
    """The same tables for steps that store several facts. Line items with their positions, and with
    what they take from their order, are worked out once, by one shuffle, and written; all facts are
    read from there. Tables that take nothing from it are as before."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        self._order_bins = written(self._bins())
        self._kept_lines = self._keep()

    def _keep(self) -> DataFrame:
        return written(self._numbered())

    def _bins(self) -> DataFrame:
        """Rows of ``key_bins`` with each order's part, quantity, whether it is only created, and the
        groups of its part; one row for each of an order's bins."""
        sums = {
            "order_part": (F.min("l_partkey"), F.min),
            "order_hundredths": (F.sum(_hundredths()), F.sum),
        }
        bins = key_bins(self.source("lineitem"), "l_orderkey", _line_bin(), sums)
        bins = bins.withColumn("order_quantity", F.col("order_hundredths") / 100).drop("order_hundredths")
        created = self._created().withColumnRenamed("o_orderkey", "created_order")
        bins = bins.join(created, F.col("_key") == F.col("created_order"), "left").drop("created_order")
        # A list, since a part that comes twice repeats the rows of those tables alone that show it.
        row = F.struct("p_name", "p_type")
        part = self.source("part").groupBy("p_partkey").agg(F.collect_list(row).alias("order_parts"))
        return lookup(bins, part, "order_part", "p_partkey", ["_key"]).drop("p_partkey")

    def _numbered(self) -> DataFrame:
        bins = self._order_bins.withColumn("order_parts", _without_names("order_parts"))
        lines = self.source("lineitem")
        return numbered_with(lines, "l_orderkey", LINE_ORDER, _line_bin(), "op_seq", bins)

    def numbered_lines(self) -> DataFrame:
        return self._kept_lines

    def _lines(self, wanted: set[str], numbered: set[str], by_order: set[str]) -> DataFrame:
        df = self._kept_lines
        return self._with_part(df, wanted) if wanted & by_order else df

    def _with_created(self, df: DataFrame) -> DataFrame:
        return df

    def _first_bins(self) -> DataFrame:
        return self._order_bins.where("_place = 1")

    def _order_totals(self) -> DataFrame:
        return self._first_bins().select(F.col("_key").alias("total_order"), "order_part", "order_quantity", "order_parts")

    def _with_part(self, df: DataFrame, wanted: set[str]) -> DataFrame:
        shown = wanted & {"ProductGroup", "MaterialText", "SOP_Relevant"}
        return df.select("*", F.inline_outer("order_parts")) if shown else df


class DealtMart(KeptMart):
    """A kept mart for facts that are stored in buckets by order: line items and orders are dealt out
    by the order's number before anything is derived from them, and line items are kept in such
    buckets. An order is then in one task, as it is in the bucket that its rows are meant for."""

    def __init__(self, spark: SparkSession, root: str, database: str, buckets: int):
        self._database, self._buckets = database, buckets
        super().__init__(spark, root)

    def _keep(self) -> DataFrame:
        name = f"{self._database}.kept_lines"
        self._numbered().write.bucketBy(self._buckets, "Order").sortBy("Order").saveAsTable(
            name, format="parquet", compression=storage.CODEC
        )
        return self.spark.table(name)

    def _dealt(self, df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("Order", _order_key(key)).repartition(self._buckets, "Order")

    def _numbered(self) -> DataFrame:
        name = F.struct(F.col("p_name").alias("part_name"))
        names = self.source("part").groupBy(F.col("p_partkey").alias("name_key"))
        names = names.agg(F.collect_list(name).alias("part_names"))
        lines = lookup(self.source("lineitem"), names, "l_partkey", "name_key", LINE_SPREAD)
        place = F.row_number().over(W.partitionBy("Order").orderBy(*LINE_ORDER)).cast("bigint")
        known = F.when(F.col("Order").isNotNull(), place)
        numbered = self._dealt(lines.drop("name_key"), "l_orderkey").withColumn("op_seq", known)
        orders = self._first_bins().withColumn("Order", _order_key("_key"))
        groups = _without_names("order_parts").alias("order_parts")
        return numbered.join(orders.select("Order", "order_part", "order_quantity", "created", groups), "Order", "left")

    def _with_order_part(
        self, df: DataFrame, key: str, wanted: set[str], by: Sequence[str]
    ) -> DataFrame:
        totals = self._order_totals().withColumn("Order", _order_key("total_order"))
        return self._with_part(self._dealt(df, key).join(totals, "Order", "left"), wanted)

    def _order_of(self, key: str) -> Column:
        return F.col("Order")

    def _with_names(self, df: DataFrame) -> DataFrame:
        return df.select("*", F.inline_outer("part_names"))
