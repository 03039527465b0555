"""A hand-made mart whose every row aims at an edge; columns left out are null."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgemart.functions import derivations as D
from forgemart.sources import schema as S
from forgemart.sources.mart import FrameMart

AS_OF = "2026-07-15"


def frame(spark: SparkSession, table: str, columns: str, rows: list[tuple]) -> DataFrame:
    names = columns.split()
    schema = S.schema(table)
    filled = []
    for row in rows:
        given = dict(zip(names, row, strict=True))
        filled.append(tuple(given.get(f.name) for f in schema))
    text = ", ".join(
        f"`{f.name}` {'string' if f.dataType.simpleString() == 'date' else f.dataType.simpleString()}"
        for f in schema
    )
    df = spark.createDataFrame(filled, text)
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def golden_mart(spark: SparkSession) -> FrameMart:
    wc = frame(
        spark,
        "WorkCenters",
        "WorkCenter WERKS NGRAD EINZH AZNOR Bottleneck",
        [
            ("WA1", "1000", 78, 8.0, 3, 0),
            ("WL1", "1000", 95, 8.0, 1, 1),
            ("WL2", "2000", 93, 8.0, 1, 1),
        ],
    ).withColumn("TheoreticalCapacityHrDay", D.capacity("NGRAD", "EINZH", "AZNOR"))
    mara = frame(
        spark,
        "MARA",
        "MATNR ProductGroup PRDHA MTART",
        [("M1", "P1", "N1", "FERT"), ("M2", "P2", "N2", "HALB"), ("M3", "P1", "N1", "FERT")],
    )
    groups = frame(
        spark,
        "ProductGroup",
        "ProductGroup Description",
        [("P1", "One"), ("P2", "Two"), ("P3", "Three")],
    )
    nodes = frame(
        spark,
        "ProductHierarchy",
        "ProductHierarchy Description Level Parent",
        [("N0", "All", 1, None), ("N1", "One", 2, "N0"), ("N2", "Two", 2, "N0")],
    )
    headers = frame(
        spark,
        "COOIS_OrderHeaders",
        "Order Material WERKS OrderQuantity SystemStatus StatusShort FinishDate DeliveredQuantity"
        " Priority SOP_Relevant",
        [
            ("O1", "M1", "1000", 10.0, "REL", "REL", "2026-07-10", 0.0, 2, 1),
            ("O2", "M2", "1000", 20.0, "REL PCNF", "PCNF", "2026-07-15", 8.0, 1, 0),
            ("O3", "M1", "2000", 5.0, "CRTD", "CRTD", "2026-07-01", 0.0, 1, 1),
            ("O4", "M3", "2000", 40.0, "rel cnf", "CNF", "2026-07-01", 40.0, 3, 0),
            ("O5", "M9", "1000", 7.0, "REL CNF DLV", "DLV", "2026-07-05", 7.0, 3, 0),
            ("O6", "M2", "1000", 12.0, "REL", "REL", "2026-08-01", 0.0, 3, 0),
        ],
    ).withColumn("Backlog", D.backlog_flag("StatusShort", "FinishDate", AS_OF))
    operations = frame(
        spark,
        "COOIS_OrderOperations",
        "Order Operation WorkCenter StatusShort TargetQuantity ActualQuantity SetupTime MachineTime"
        " BottleneckOperation",
        [
            ("O1", "0010", "WA1", "REL", 10.0, 0.0, 1.0, 3.0, 0),
            ("O1", "0020", "WL1", "REL", 10.0, 0.0, 0.5, 2.0, 1),
            ("O2", "0010", "WA1", "CNF", 20.0, 20.0, 1.0, 4.0, 0),
            ("O2", "0020", "WL1", "PCNF", 20.0, 8.0, 0.5, 6.0, 1),
            ("O3", "0010", "WL2", "CRTD", 5.0, 0.0, 0.5, 1.0, 1),
            ("O4", "0010", "WL2", "CNF", 40.0, 40.0, 1.0, 8.0, 1),
            ("O4", "0020", "WL2", "CNF", 40.0, 40.0, 0.3, 2.0, 0),
            ("O5", "0010", "WA1", "CNF", 7.0, 7.0, 0.5, 1.0, 0),
        ],
    )
    end = datetime(2026, 7, 1, 12)
    confirmations = frame(
        spark,
        "COOIS_Confirmations",
        "Confirmation Order Operation WorkCenter YieldQuantity ScrapQuantity ReworkQuantity"
        " DelayHours ActualEnd",
        [
            ("C1", "O2", "0010", "WA1", 20.0, 1.0, 0.0, 0.5, end),
            ("C2", "O2", "0020", "WL1", 8.0, 2.0, 1.0, 24.0, end),
            ("C3", "O4", "0010", "WL2", 40.0, 0.0, 0.0, 2.0, end),
            ("C4", "O4", "0020", "WL2", 40.0, 3.0, 2.0, None, end),
            ("C5", "O5", "0010", "WA1", 0.0, 0.0, 0.0, 1.0, end),
        ],
    )
    gap = D.shortage("Reqmnt_qty", "Comm_qty", "Qty_issued")
    co24 = (
        frame(
            spark,
            "CO24",
            "Order Component Reqmnt_qty Comm_qty Qty_issued",
            [
                ("O1", "M2", 10.0, 4.0, 1.0),
                ("O1", "M3", 0.8, 0.7, 0.1),
                ("O2", "M1", 6.0, 6.0, 2.0),
                ("O2", "M1", 2.5, 0.0, 0.0),
                ("O2", "M1", 2.5, 0.0, 0.0),
            ],
        )
        .withColumn("ShortageQuantity", gap)
        .withColumn("MissingPart", D.missing_part("ShortageQuantity"))
    )
    matdoc = frame(
        spark,
        "MATDOC",
        "Mblnr Order MovementType Quantity",
        [
            ("D1", "O4", "101", 38.0),
            ("D2", "O5", "101", 7.0),
            ("D3", "O2", "261", 15.0),
            ("D4", "O2", "262", 1.0),
            ("D5", "O9", "311", 4.0),
        ],
    )
    types = frame(
        spark,
        "MovementTypes",
        "MovementType Sign Direction",
        [("101", "+", "GR"), ("261", "-", "GI"), ("262", "+", "GI"), ("311", "0", "TR")],
    )
    sop = frame(
        spark,
        "SOP_Targets",
        "ProductGroup WERKS Period TargetQuantity ActualQuantity Deviation",
        [
            ("P1", "1000", "202607", 100.0, 90.0, -10.0),
            ("P2", "1000", "202607", 50.0, 60.0, 10.0),
            ("P3", "1000", "202607", 30.0, 0.0, -30.0),
        ],
    )
    return FrameMart(
        {
            "WorkCenters": wc,
            "MARA": mara,
            "ProductGroup": groups,
            "ProductHierarchy": nodes,
            "COOIS_OrderHeaders": headers,
            "COOIS_OrderOperations": operations,
            "COOIS_Confirmations": confirmations,
            "CO24": co24,
            "MATDOC": matdoc,
            "MovementTypes": types,
            "SOP_Targets": sop,
        }
    )
