"""Schemas, keys and default aggregates of the seventeen mart tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of the mart tables.
DDL = {
    "ProductGroup": "ProductGroup string, Description string",
    "ProductHierarchy": "ProductHierarchy string, Description string, Level int, Parent string",
    "MRP_Cntr": "DISPO string, WERKS string, Name string, ResponsibilityArea string, Email string",
    "ActivityTypes": "ActivityType string, Description string, Unit string",
    "MovementTypes": "MovementType string, Description string, Sign string, Direction string",
    "WorkCenters": (
        "WorkCenter string, WERKS string, Description string, NGRAD int, EINZH double, AZNOR int,"
        " CapacityCategory string, Bottleneck int, TheoreticalCapacityHrDay double"
    ),
    "MARA": (
        "MATNR string, MTART string, MATKL string, MEINS string, NTGEW double, GEWEI string,"
        " PRDHA string, ProductGroup string, MAKTX string"
    ),
    "MARC": (
        "MATNR string, WERKS string, DISPO string, BESKZ string, FEVOR string, DZEIT int,"
        " InHouseProductionTimeDays double"
    ),
    "MARD": "MATNR string, WERKS string, LGORT string, LABST double, INSME double, StockDate date",
    "D_Part": (
        "MATNR string, ProductGroup string, Description string, ABC_Class string,"
        " XYZ_Class string, CriticalPart int, StandardPrice double"
    ),
    "tmp_PartStockV1": (
        "Part string, WERKS string, Stock double, Unit string, SnapshotTime timestamp"
    ),
    "COOIS_OrderHeaders": (
        "Order string, Material string, MaterialText string, WERKS string, OrderType string,"
        " OrderQuantity double, Unit string, SystemStatus string, StatusShort string,"
        " Priority int, SOP_Relevant int, Backlog int, CreationDate date, StartDate date,"
        " FinishDate date, DeliveredQuantity double, ProductGroup string"
    ),
    "COOIS_OrderOperations": (
        "Order string, Operation string, WorkCenter string, WERKS string, OperationText string,"
        " StatusShort string, SystemStatus string, ControlKey string, TargetQuantity double,"
        " ActualQuantity double, SetupTime double, MachineTime double, LaborTime double,"
        " StartDate date, FinishDate date, Material string, ProductGroup string,"
        " BottleneckOperation int"
    ),
    "COOIS_Confirmations": (
        "Confirmation string, Order string, Operation string, WorkCenter string, WERKS string,"
        " YieldQuantity double, ScrapQuantity double, ReworkQuantity double,"
        " ActualMachineTime double, ActualLaborTime double, ActualEnd timestamp,"
        " SAP_PostingTime timestamp, DelayHours double, Cancelled int, Material string"
    ),
    "CO24": (
        "Order string, Component string, WERKS string, LGORT string, Reqmnt_qty double,"
        " Comm_qty double, Qty_issued double, ShortageQuantity double, MissingPart int,"
        " RequirementDate date, ComponentText string"
    ),
    "MATDOC": (
        "Mblnr string, Line string, Matnr string, WERKS string, LGORT string,"
        " MovementType string, Quantity double, Unit string, PostingDate date,"
        " DocumentDate date, Order string, CostCenter string"
    ),
    "SOP_Targets": (
        "ProductGroup string, Description string, WERKS string, Period string,"
        " TargetQuantity double, ActualQuantity double, Deviation double, Version string"
    ),
}

# Columns that identify a row. CO24 repeats components, so it has none.
KEYS = {
    "ProductGroup": ("ProductGroup",),
    "ProductHierarchy": ("ProductHierarchy",),
    "MRP_Cntr": ("DISPO",),
    "ActivityTypes": ("ActivityType",),
    "MovementTypes": ("MovementType",),
    "WorkCenters": ("WorkCenter",),
    "MARA": ("MATNR",),
    "MARC": ("MATNR", "WERKS"),
    "MARD": ("MATNR", "WERKS", "LGORT"),
    "D_Part": ("MATNR",),
    "tmp_PartStockV1": ("Part", "WERKS"),
    "COOIS_OrderHeaders": ("Order",),
    "COOIS_OrderOperations": ("Order", "Operation"),
    "COOIS_Confirmations": ("Confirmation",),
    "MATDOC": ("Mblnr", "Line"),
    "SOP_Targets": ("ProductGroup", "WERKS", "Period", "Version"),
}

TABLES = tuple(DDL)


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def schema(table: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(name, _TYPES[kind])
            for name, kind in (item.split() for item in DDL[table].split(","))
        ]
    )


def column_names(table: str) -> list[str]:
    return [item.split()[0] for item in DDL[table].split(",")]


def summable_columns(table: str) -> list[str]:
    """Numeric columns: their default aggregate is a sum, every other column has none."""
    numeric = ("int", "double")
    return [
        name
        for name, kind in (item.split() for item in DDL[table].split(","))
        if kind in numeric
    ]


def physical_name(table: str) -> str:
    return table.lower()
