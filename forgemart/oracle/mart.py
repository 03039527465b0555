"""Mart tables as SQL over the given tables, written apart from the Spark binding."""

from __future__ import annotations

import re


def _pad(expr: str, width: int) -> str:
    text = f"CAST({expr} AS VARCHAR)"
    return f"lpad({text}, CAST(greatest(length({text}), {width}) AS INTEGER), '0')"


_STATUS = """CASE
    WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '5%' THEN 'CRTD'
    WHEN o_orderstatus = 'O' THEN 'REL'
    WHEN o_orderstatus = 'P' THEN 'PCNF'
    WHEN o_orderpriority LIKE '1%' THEN 'CNF'
    WHEN o_orderpriority LIKE '2%' THEN 'DLV'
    WHEN o_orderpriority LIKE '3%' THEN 'TECO'
    ELSE 'CLSD' END"""


def _system(expr: str) -> str:
    return f"""CASE {expr}
    WHEN 'CRTD' THEN 'CRTD' WHEN 'REL' THEN 'REL' WHEN 'PCNF' THEN 'REL PCNF'
    WHEN 'CNF' THEN 'REL CNF' WHEN 'DLV' THEN 'REL CNF DLV'
    WHEN 'TECO' THEN 'REL CNF DLV TECO' WHEN 'CLSD' THEN 'REL CNF DLV TECO CLSD' END"""


ROLE_TEXTS = """CASE l_linenumber
    WHEN 1 THEN 'CNC Turning' WHEN 2 THEN 'CNC Milling' WHEN 3 THEN 'Winding'
    WHEN 4 THEN 'Laser Balancing' WHEN 5 THEN 'Assembly' WHEN 6 THEN 'Painting'
    WHEN 7 THEN 'Final Inspection' END"""

CONTROLLER = """CASE
    WHEN p_partkey % 4 = 0 THEN '201'
    WHEN p_type IN ('PROMO', 'SMALL', 'STANDARD') THEN '101'
    WHEN p_type IN ('MEDIUM', 'ECONOMY') THEN '102'
    WHEN p_type = 'LARGE' THEN '103' END"""

CTES = {
    "lines": """
  SELECT *,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey,
      l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus)
      AS op_seq,
    CAST(l_quantity AS BIGINT) AS q,
    CAST(round(l_discount * 100) AS BIGINT) AS dp,
    CAST(round(l_tax * 100) AS BIGINT) AS tp,
    (CAST(round(l_extendedprice * 100) AS BIGINT) + 5000) // 10000 AS mach
  FROM lineitem""",
    "order_parts": """
  SELECT l_orderkey AS okey, min(l_partkey) AS order_part,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS order_quantity
  FROM lineitem GROUP BY l_orderkey""",
    "order_base": f"""
  SELECT o_orderkey AS okey, {_STATUS} AS st,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio,
    CAST(o_orderdate AS DATE) AS created
  FROM orders""",
    "hdr": f"""
  SELECT {_pad("b.okey", 18)} AS "Order", {_pad("t.order_part", 18)} AS Material,
    p_name AS MaterialText,
    CASE WHEN t.order_part % 4 = 0 THEN '2000' ELSE '1000' END AS WERKS,
    'PP01' AS OrderType, t.order_quantity AS OrderQuantity, 'PC' AS Unit,
    {_system("st")} AS SystemStatus, st AS StatusShort, CAST(prio AS BIGINT) AS Priority,
    CAST(CASE WHEN p_type IN ('LARGE', 'PROMO') AND b.okey % 10 < 7 THEN 1 ELSE 0 END AS BIGINT)
      AS SOP_Relevant,
    CAST(CASE WHEN st IN ('CRTD', 'REL', 'PCNF')
      AND created + prio + CAST(3 + b.okey % 18 AS INTEGER) < DATE '2000-01-01'
      THEN 1 ELSE 0 END AS BIGINT) AS Backlog,
    created AS CreationDate, created + prio AS StartDate,
    created + prio + CAST(3 + b.okey % 18 AS INTEGER) AS FinishDate,
    CASE WHEN st IN ('CRTD', 'REL') THEN 0.0::DOUBLE
      WHEN st = 'PCNF' THEN floor(t.order_quantity / 2) ELSE t.order_quantity END
      AS DeliveredQuantity,
    p_type AS ProductGroup
  FROM order_base b LEFT JOIN order_parts t USING (okey)
    LEFT JOIN part ON p_partkey = t.order_part""",
    "ops": f"""
  SELECT {_pad("l_orderkey", 18)} AS "Order", {_pad("op_seq * 10", 4)} AS Operation,
    'WC' || {_pad("l_suppkey", 8)} AS WorkCenter, h.WERKS, {ROLE_TEXTS} AS OperationText,
    s.st AS StatusShort, {_system("s.st")} AS SystemStatus, 'PP01' AS ControlKey,
    CAST(q AS DOUBLE) AS TargetQuantity,
    CAST(CASE l_returnflag WHEN 'R' THEN q WHEN 'A' THEN q // 2 ELSE 0 END AS DOUBLE)
      AS ActualQuantity,
    tp * 10 / 100.0::DOUBLE AS SetupTime, mach / 100.0::DOUBLE AS MachineTime,
    (mach * 3 // 5) / 100.0::DOUBLE AS LaborTime,
    CAST(l_shipdate AS DATE) AS StartDate,
    CAST(l_shipdate AS DATE) + CAST((tp * 10 + mach) // 800 AS INTEGER) AS FinishDate,
    h.Material, h.ProductGroup,
    CAST(CASE WHEN l_linenumber = 4 THEN 1 ELSE 0 END AS BIGINT) AS BottleneckOperation
  FROM (
    SELECT l.*, CASE l_returnflag WHEN 'R' THEN 'CNF' WHEN 'A' THEN 'PCNF'
      ELSE CASE WHEN b.st = 'CRTD' THEN 'CRTD' ELSE 'REL' END END AS st
    FROM lines l LEFT JOIN order_base b ON b.okey = l_orderkey) s
  LEFT JOIN hdr h ON h."Order" = {_pad("l_orderkey", 18)}""",
    "conf": f"""
  SELECT {_pad(f"l_orderkey || {_pad('op_seq', 4)}", 12)} AS Confirmation,
    {_pad("l_orderkey", 18)} AS "Order", {_pad("op_seq * 10", 4)} AS Operation,
    'WC' || {_pad("l_suppkey", 8)} AS WorkCenter, h.WERKS,
    CAST(CASE WHEN l_returnflag = 'R' THEN q ELSE q // 2 END AS DOUBLE) AS YieldQuantity,
    CAST(q * dp // 100 AS DOUBLE) AS ScrapQuantity,
    CAST(q * tp // 100 AS DOUBLE) AS ReworkQuantity,
    mach / 100.0::DOUBLE AS ActualMachineTime, (mach * 3 // 5) / 100.0::DOUBLE AS ActualLaborTime,
    l_shipdate + to_hours(3 * l_linenumber) AS ActualEnd,
    l_shipdate + to_hours(3 * l_linenumber) + to_minutes(minutes) AS SAP_PostingTime,
    minutes / 60.0::DOUBLE AS DelayHours, CAST(0 AS BIGINT) AS Cancelled, h.Material
  FROM (SELECT *, [6, 18, 45, 90, 150, 300, 720, 2160][l_partkey % 8 + 1] AS minutes
    FROM lines WHERE l_returnflag IN ('A', 'R')) s
  LEFT JOIN hdr h ON h."Order" = {_pad("l_orderkey", 18)}""",
    "co24": f"""
  SELECT *, CAST(CASE WHEN ShortageQuantity > 0 THEN 1 ELSE 0 END AS BIGINT) AS MissingPart
  FROM (
    SELECT {_pad("l_orderkey", 18)} AS "Order", {_pad("l_partkey", 18)} AS Component,
      h.WERKS, '0001' AS LGORT, CAST(q AS DOUBLE) AS Reqmnt_qty,
      ((q * (100 - 5 * dp) + 5) // 10) / 10.0::DOUBLE AS Comm_qty,
      ((q * tp + 5) // 10) / 10.0::DOUBLE AS Qty_issued,
      greatest(0, q * 10 - (q * (100 - 5 * dp) + 5) // 10 - (q * tp + 5) // 10) / 10.0::DOUBLE
        AS ShortageQuantity,
      CAST(l_shipdate AS DATE) AS RequirementDate, p_name AS ComponentText
    FROM lines LEFT JOIN part ON p_partkey = l_partkey
      LEFT JOIN hdr h ON h."Order" = {_pad("l_orderkey", 18)})""",
    "matdoc": f"""
  SELECT {_pad(f"l_orderkey || {_pad('op_seq', 4)}", 10)} AS Mblnr, '0001' AS Line,
    {_pad("l_partkey", 18)} AS Matnr, h.WERKS, '0001' AS LGORT,
    CASE l_returnflag || l_linestatus WHEN 'RF' THEN '101' WHEN 'AF' THEN '261'
      WHEN 'NF' THEN '261' WHEN 'NO' THEN '531' WHEN 'AO' THEN '311' WHEN 'RO' THEN '262' END
      AS MovementType,
    CAST(q AS DOUBLE) AS Quantity, 'PC' AS Unit, CAST(l_shipdate AS DATE) AS PostingDate,
    CAST(l_shipdate AS DATE) + CAST(l_partkey % 5 - 2 AS INTEGER) AS DocumentDate,
    {_pad("l_orderkey", 18)} AS "Order", 'CC100' AS CostCenter
  FROM lines LEFT JOIN hdr h ON h."Order" = {_pad("l_orderkey", 18)}""",
    "sop": """
  SELECT ProductGroup, upper(ProductGroup[1]) || lower(ProductGroup[2:]) AS Description, WERKS,
    Period, target / 100.0::DOUBLE AS TargetQuantity, CAST(actual AS DOUBLE) AS ActualQuantity,
    CAST(round((actual * 100 - target) / 100.0::DECIMAL(18, 2), 1) AS DOUBLE) AS Deviation,
    'V01' AS Version
  FROM (
    SELECT p_type AS ProductGroup,
      CASE WHEN l_partkey % 4 = 0 THEN '2000' ELSE '1000' END AS WERKS,
      strftime(l_shipdate, '%Y%m') AS Period, sum(q) AS actual,
      sum(q * (90 + 5 * (month(l_shipdate) % 5))) AS target
    FROM lines LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL)""",
    "mara": f"""
  SELECT {_pad("p_partkey", 18)} AS MATNR,
    CASE WHEN p_type IN ('LARGE', 'PROMO') THEN 'FERT' ELSE 'HALB' END AS MTART,
    p_brand AS MATKL, 'PC' AS MEINS, CAST(p_size AS DOUBLE) AS NTGEW, 'KG' AS GEWEI,
    'RE-' || p_type AS PRDHA, p_type AS ProductGroup, p_name AS MAKTX
  FROM part""",
    "marc": f"""
  SELECT {_pad("p_partkey", 18)} AS MATNR,
    CASE WHEN p_partkey % 4 = 0 THEN '2000' ELSE '1000' END AS WERKS, {CONTROLLER} AS DISPO,
    CASE WHEN p_type IN ('LARGE', 'PROMO') THEN 'E' ELSE 'F' END AS BESKZ, 'PP01' AS FEVOR,
    CAST(p_partkey % 6 + 2 AS BIGINT) AS DZEIT,
    (3 + p_size % 30) / 10.0::DOUBLE AS InHouseProductionTimeDays
  FROM part""",
    "mard": f"""
  SELECT {_pad("p_partkey", 18)} AS MATNR,
    CASE WHEN p_partkey % 4 = 0 THEN '2000' ELSE '1000' END AS WERKS, LGORT,
    CAST(p_partkey * f % 250 AS DOUBLE) AS LABST, CAST((p_partkey + f) % 9 AS DOUBLE) AS INSME,
    DATE '2000-01-01' - CAST(p_partkey % 40 + 1 AS INTEGER) AS StockDate
  FROM part, (VALUES ('0001', 7), ('0002', 11)) loc (LGORT, f)""",
    "dpart": f"""
  SELECT {_pad("p_partkey", 18)} AS MATNR, p_type AS ProductGroup, p_name AS Description,
    CASE WHEN p_size <= 25 THEN 'A' WHEN p_size <= 40 THEN 'B' ELSE 'C' END AS ABC_Class,
    ['X', 'Y', 'Z'][p_size % 3 + 1] AS XYZ_Class,
    CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS CriticalPart,
    p_retailprice AS StandardPrice
  FROM part""",
    "stock": f"""
  SELECT {_pad("p_partkey", 18)} AS Part,
    CASE WHEN p_partkey % 4 = 0 THEN '2000' ELSE '1000' END AS WERKS,
    CAST(p_partkey * 7 % 250 + p_partkey * 11 % 250 AS DOUBLE) AS Stock, 'PC' AS Unit,
    TIMESTAMP '2000-01-01 07:30:00' - to_hours(CAST(p_partkey % 12 + 1 AS INTEGER))
      AS SnapshotTime
  FROM part""",
    "wc": f"""
  SELECT *, CAST(round(NGRAD * 8 * AZNOR / 100.0::DECIMAL(9, 2), 2) AS DOUBLE)
    AS TheoreticalCapacityHrDay
  FROM (
    SELECT 'WC' || {_pad("s_suppkey", 8)} AS WorkCenter,
      CASE WHEN s_nationkey % 2 = 0 THEN '1000' ELSE '2000' END AS WERKS, s_name AS Description,
      CAST(60 + s_suppkey % 31 AS BIGINT) AS NGRAD, 8.0::DOUBLE AS EINZH,
      CAST(1 + s_suppkey % 3 AS BIGINT) AS AZNOR, '001' AS CapacityCategory,
      CAST(CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS Bottleneck
    FROM supplier)""",
    "pg": """
  SELECT DISTINCT p_type AS ProductGroup, upper(p_type[1]) || lower(p_type[2:]) AS Description
  FROM part""",
    "hier": """
  SELECT 'RE-ALL' AS ProductHierarchy, 'All' AS Description, CAST(1 AS BIGINT) AS Level,
    NULL AS Parent
  UNION ALL
  SELECT DISTINCT 'RE-' || MTART, MTART, 2, 'RE-ALL' FROM mara
  UNION ALL
  SELECT DISTINCT PRDHA, upper(ProductGroup[1]) || lower(ProductGroup[2:]), 3, 'RE-' || MTART
  FROM mara""",
    "mrp": """
  SELECT * FROM (VALUES
    ('101', '1000', 'Controller 101', 'Rotating parts', 'c101@example.org'),
    ('102', '1000', 'Controller 102', 'Housings and shields', 'c102@example.org'),
    ('103', '1000', 'Controller 103', 'Motors', 'c103@example.org'),
    ('201', '2000', 'Controller 201', 'Whole plant 2000', 'c201@example.org'))
    t (DISPO, WERKS, Name, ResponsibilityArea, Email)""",
    "acts": """
  SELECT * FROM (VALUES ('MACH', 'Hours of the machine', 'HR'),
    ('LABR', 'Hours of the operator', 'HR'), ('SETUP', 'Hours of the set-up', 'HR'))
    t (ActivityType, Description, Unit)""",
    "mtypes": """
  SELECT * FROM (VALUES ('101', 'Movement 101', '+', 'GR'), ('102', 'Movement 102', '-', 'GR'),
    ('261', 'Movement 261', '-', 'GI'), ('262', 'Movement 262', '+', 'GI'),
    ('531', 'Movement 531', '+', 'GR'), ('311', 'Movement 311', '0', 'TR'))
    t (MovementType, Description, Sign, Direction)""",
}

TABLE_CTE = {
    "ProductGroup": "pg",
    "ProductHierarchy": "hier",
    "MRP_Cntr": "mrp",
    "ActivityTypes": "acts",
    "MovementTypes": "mtypes",
    "WorkCenters": "wc",
    "MARA": "mara",
    "MARC": "marc",
    "MARD": "mard",
    "D_Part": "dpart",
    "tmp_PartStockV1": "stock",
    "COOIS_OrderHeaders": "hdr",
    "COOIS_OrderOperations": "ops",
    "COOIS_Confirmations": "conf",
    "CO24": "co24",
    "MATDOC": "matdoc",
    "SOP_Targets": "sop",
}


def with_mart(sql: str) -> str:
    """The statement with the mart tables it names, and those that they need, in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                need(body)
                if name not in needed:
                    needed.append(name)

    need(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS ({CTES[name]}\n)" for name in needed)
    recursive = "RECURSIVE " if sql.lstrip().startswith("RECURSIVE") else ""
    body = sql.lstrip().removeprefix("RECURSIVE").lstrip()
    if body.startswith("WITH "):
        return f"WITH {recursive}{ctes},\n{body.removeprefix('WITH ')}"
    return f"WITH {recursive}{ctes}\n{body}"
