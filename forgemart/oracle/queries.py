"""SQL counterpart of every registered query."""

from __future__ import annotations

from collections.abc import Sequence

from forgemart.oracle.mart import CONTROLLER, ROLE_TEXTS, TABLE_CTE, _pad, with_mart
from forgemart.sources.schema import KEYS, TABLES, column_names, summable_columns


def _sum(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(18, 4))) AS DOUBLE)"


def _q(name: str) -> str:
    return f'"{name}"'


RAW: dict[str, str] = {}

# ---- scans, sources, sinks --------------------------------------------------------------

RAW["s01_scan"] = "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS "table", count(*) AS "rows",
      CAST({len(column_names(t))} AS BIGINT) AS "columns",
      {" + ".join(f'count({_q(c)})' for c in column_names(t))} AS filled_cells
    FROM {TABLE_CTE[t]}"""
    for t in TABLES
)

RAW["s02_map_columns"] = """
SELECT l_orderkey AS "Order", l_partkey AS Component, l_quantity AS Reqmnt_qty FROM lineitem"""

RAW["s03_conform"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS "Order", CAST(l_partkey AS VARCHAR) AS Component,
  CAST(NULL AS VARCHAR) AS WERKS, l_returnflag AS LGORT,
  CAST(l_linenumber AS DOUBLE) AS Reqmnt_qty,
  CASE WHEN l_linestatus = 'O' THEN l_quantity END AS Comm_qty,
  CAST(l_suppkey AS DOUBLE) AS Qty_issued, l_discount AS ShortageQuantity,
  CAST(trunc(-l_extendedprice) AS BIGINT) AS MissingPart,
  CAST(l_shipdate AS DATE) AS RequirementDate, l_linestatus AS ComponentText
FROM lineitem"""

RAW["s04_overwrite"] = "SELECT * FROM mara"

RAW["s05_row_counts"] = "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS "table", count(*) AS "rows" FROM {TABLE_CTE[t]}""" for t in TABLES
)

RAW["s06_run_log"] = "\nUNION ALL\n".join(
    f"""SELECT 'save {t}' AS step, 'ok' AS status, CAST(count(*) AS VARCHAR) AS detail
    FROM {TABLE_CTE[t]}"""
    for t in TABLES
)

RAW["s07_refresh"] = "SELECT * FROM mard"

RAW["s08_validate"] = """
SELECT 'CO24' AS "table", 'MissingPart' AS "column", 'int' AS expected, 'missing' AS found,
  count(*) AS "rows" FROM co24
UNION ALL SELECT 'MARC', 'DZEIT', 'int', 'string', count(*) FROM marc
UNION ALL SELECT 'MATDOC', NULL, 'table', 'missing', NULL"""

# ---- derivations ------------------------------------------------------------------------

_ROLE = """CASE l_linenumber WHEN 1 THEN 'TURN' WHEN 2 THEN 'MILL' WHEN 3 THEN 'WIND'
  WHEN 4 THEN 'LASER' WHEN 5 THEN 'ASSY' WHEN 6 THEN 'PAINT' WHEN 7 THEN 'INSP' END"""

RAW["d01_pad_key"] = f"""
SELECT o_orderkey, {_pad("o_orderkey", 18)} AS key18, {_pad("o_orderkey", 12)} AS key12,
  {_pad("o_orderkey", 10)} AS key10, {_pad("o_orderkey", 3)} AS key3
FROM orders"""

RAW["d02_same_number"] = f"""
SELECT {_pad("o_orderkey", 18)} AS "Order", CAST(o_orderkey AS VARCHAR) AS number,
  CAST(1 AS BIGINT) AS same_order,
  CAST(o_orderkey = o_custkey AS BIGINT) AS same_customer
FROM orders"""

RAW["d03_code_text"] = f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CASE WHEN l_linestatus = 'O' THEN {_ROLE} ELSE 'GRIND' END AS code,
  CASE WHEN l_linestatus = 'O' THEN {ROLE_TEXTS} ELSE 'GRIND' END AS code_text
FROM lineitem"""

RAW["d04_system_status"] = """
SELECT "Order", StatusShort, SystemStatus AS derived_status FROM hdr"""

RAW["d05_released"] = """
SELECT "Order", CAST(StatusShort <> 'CRTD' AS BIGINT) AS released,
  CAST(contains(SystemStatus, 'REL') AS BIGINT) AS released_exact
FROM hdr"""

RAW["d06_backlog"] = """
SELECT "Order", CAST(StatusShort IN ('CRTD', 'REL', 'PCNF')
  AND FinishDate < DATE '1998-07-15' AS BIGINT) AS backlog
FROM hdr"""

RAW["d07_capacity"] = """
SELECT 'WC' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS WorkCenter,
  ((60 + s_suppkey % 31) * 8 * (1 + s_suppkey % 3)) / 100.0::DOUBLE AS capacity
FROM supplier"""

RAW["d08_shortage"] = """
SELECT "Order", Component, RequirementDate, ShortageQuantity AS shortage,
  MissingPart AS missing,
  CAST(CASE WHEN RequirementDate <= DATE '2000-01-01' THEN MissingPart ELSE 0 END AS BIGINT)
    AS missing_and_due
FROM co24"""

RAW["d09_posting_delay"] = """
SELECT "Order", WorkCenter, ActualEnd, SAP_PostingTime,
  date_diff('minute', ActualEnd, SAP_PostingTime) / 60.0::DOUBLE AS delay
FROM conf"""

RAW["d10_sop_deviation"] = """
SELECT ProductGroup, WERKS, Period, CAST(round(CAST(ActualQuantity AS DECIMAL(18, 4))
  - CAST(TargetQuantity AS DECIMAL(18, 4)), 1) AS DOUBLE) AS deviation
FROM sop"""

RAW["d11_period"] = """
SELECT "Order", Matnr, strftime(PostingDate, '%Y%m') AS posting_period,
  strftime(DocumentDate, '%Y%m') AS document_period
FROM matdoc"""

RAW["d12_procurement"] = """
SELECT MATNR, MTART, CASE WHEN MTART = 'FERT' THEN 'E' ELSE 'F' END AS BESKZ FROM mara"""

RAW["d13_mrp_controller"] = f"SELECT p_partkey, p_type, {CONTROLLER} AS DISPO FROM part"

RAW["d14_bottleneck_flag"] = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CAST(l_linenumber = 4 AS BIGINT) AS flag
FROM lineitem"""

RAW["d15_operation_no"] = 'SELECT "Order", Operation, WorkCenter FROM ops'

RAW["d16_work_center"] = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CASE WHEN l_partkey % 4 = 0 THEN '2000' ELSE '1000' END AS WERKS,
  CASE WHEN l_partkey % 4 = 0
    THEN ['WC-TURN02', 'WC-TURN02', 'WC-ASSY02', 'WC-LASER02', 'WC-ASSY02', 'WC-PAINT01',
      'WC-LASER02'][l_linenumber]
    ELSE ['WC-TURN01', 'WC-MILL01', 'WC-WIND01', 'WC-LASER01', 'WC-ASSY01', 'WC-PAINT01',
      'WC-INSP01'][l_linenumber] END AS WorkCenter
FROM lineitem"""

RAW["d17_op_duration"] = """
SELECT "Order", WorkCenter, SetupTime, MachineTime,
  greatest(0.5::DOUBLE, (SetupTime + MachineTime) / 8) AS duration_days
FROM ops"""

RAW["d18_schedule"] = """
WITH timed AS (
  SELECT "Order", Operation, CAST(Operation AS BIGINT) AS n, h.StartDate AS first_day,
    CAST(round(greatest(0.5::DOUBLE, (SetupTime + MachineTime) / 8) * 86400) AS BIGINT) AS secs
  FROM ops o LEFT JOIN hdr h USING ("Order")),
placed AS (
  SELECT *, coalesce(sum(secs + 21600) OVER (PARTITION BY "Order" ORDER BY n
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed
  FROM timed)
SELECT "Order", Operation,
  CAST(first_day AS TIMESTAMP) + to_seconds(CAST(passed AS BIGINT)) AS ScheduledStart,
  CAST(first_day AS TIMESTAMP) + to_seconds(CAST(passed + secs AS BIGINT)) AS ScheduledEnd
FROM placed"""

RAW["d19_op_status"] = """
WITH plan AS (
  SELECT "Order", done, n, st FROM (
    SELECT "Order", count(*) AS n, count_if(StatusShort = 'CNF') AS done FROM ops GROUP BY "Order")
  JOIN (SELECT "Order", StatusShort AS st FROM hdr) USING ("Order")),
done AS (
  SELECT "Order", st, CASE WHEN st IN ('CNF', 'DLV', 'TECO', 'CLSD') THEN n
    WHEN st IN ('PCNF', 'REL') THEN done ELSE 0 END AS k
  FROM plan)
SELECT "Order", Operation, CASE WHEN CAST(Operation AS BIGINT) // 10 <= k THEN 'CNF'
  WHEN st = 'PCNF' AND CAST(Operation AS BIGINT) // 10 = k + 1 THEN 'PCNF'
  WHEN st = 'CRTD' THEN 'CRTD' ELSE 'REL' END AS op_status
FROM ops JOIN done USING ("Order")"""

RAW["d20_delivered"] = """
SELECT "Order", StatusShort, OrderQuantity, CASE
  WHEN StatusShort IN ('CNF', 'DLV', 'TECO', 'CLSD') THEN OrderQuantity
  WHEN StatusShort = 'PCNF' THEN
    CAST(CAST(OrderQuantity AS BIGINT) * (CAST("Order" AS BIGINT) % 5 + 3) // 10 AS DOUBLE)
  ELSE 0.0::DOUBLE END AS delivered
FROM hdr"""

RAW["d21_hierarchy_key"] = "SELECT p_partkey, 'RE-' || p_type AS PRDHA FROM part"

RAW["d22_signed_qty"] = """
SELECT "Order", Matnr, MovementType, CASE Sign WHEN '+' THEN Quantity WHEN '-' THEN -Quantity
  ELSE 0.0::DOUBLE END AS SignedQuantity
FROM matdoc JOIN mtypes USING (MovementType)"""

RAW["d23_to_date"] = """
SELECT "Order", CAST(ActualEnd AS DATE) AS end_day, CAST(SAP_PostingTime AS DATE) AS posting_day
FROM conf"""

RAW["d24_round"] = """
WITH cents AS (
  SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
  ((c + 5) // 10) / 10.0::DOUBLE AS half_up,
  (CASE WHEN c % 10 = 5 AND c // 10 % 2 = 0 THEN c // 10 ELSE (c + 5) // 10 END)
    / 10.0::DOUBLE AS half_even,
  ((c + 2) // 4) / 100.0::DOUBLE AS quarter
FROM cents"""

RAW["d25_format"] = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  format('{:,}', CAST(round(CAST(l_extendedprice AS DECIMAL(18, 4)), 0) AS BIGINT)) AS whole,
  CAST(round(CAST(l_extendedprice AS DECIMAL(18, 4)), 1) AS VARCHAR) AS one_digit,
  CAST(CAST(round(l_discount * 100) AS DECIMAL(9, 1)) AS VARCHAR) || '%' AS percent,
  strftime(l_shipdate, '%Y-%m-%d') AS day, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS moment
FROM lineitem"""

RAW["d26_status_text"] = """
SELECT "Order", StatusShort, CASE StatusShort WHEN 'CRTD' THEN 'created' WHEN 'REL' THEN 'released'
  WHEN 'PCNF' THEN 'partially confirmed' WHEN 'CNF' THEN 'confirmed' WHEN 'DLV' THEN 'delivered'
  WHEN 'TECO' THEN 'technically completed' WHEN 'CLSD' THEN 'closed' END AS status_text
FROM hdr"""

RAW["d27_filter_eq"] = 'SELECT "Order", WorkCenter FROM ops WHERE BottleneckOperation = 1'

RAW["d28_filter_in"] = """
SELECT "Order", StatusShort FROM hdr WHERE StatusShort IN ('CRTD', 'REL', 'PCNF')"""

# ---- row generators ---------------------------------------------------------------------

RAW["x01_routing"] = """
WITH routes AS (
  SELECT * FROM (VALUES
    ('PROMO', ['TURN', 'MILL', 'LASER', 'INSP']), ('SMALL', ['TURN', 'MILL', 'INSP']),
    ('STANDARD', ['TURN', 'MILL', 'INSP']), ('MEDIUM', ['MILL', 'PAINT', 'INSP']),
    ('LARGE', ['WIND', 'ASSY', 'LASER', 'INSP']), ('ECONOMY', ['TURN', 'INSP']))
    t (ProductGroup, roles)),
steps AS (
  SELECT ProductGroup, unnest(range(1, len(roles) + 1)) AS position, unnest(roles) AS role
  FROM routes)
SELECT "Order", ProductGroup, position, role FROM hdr JOIN steps USING (ProductGroup)"""

RAW["x02_storage_locations"] = "SELECT MATNR, WERKS, LGORT FROM mard"

RAW["x03_periods"] = """
WITH span AS (
  SELECT ProductGroup, strptime(min(Period) || '01', '%Y%m%d') AS f,
    strptime(max(Period) || '01', '%Y%m%d') AS l
  FROM sop GROUP BY ProductGroup)
SELECT ProductGroup,
  strftime(unnest(generate_series(f, l + INTERVAL 6 MONTH, INTERVAL 1 MONTH)), '%Y%m') AS Period
FROM span"""

RAW["x04_sop_grid"] = """
WITH months AS (
  SELECT strftime(unnest(generate_series(strptime(min(Period) || '01', '%Y%m%d'),
    strptime(max(Period) || '01', '%Y%m%d'), INTERVAL 1 MONTH)), '%Y%m') AS Period
  FROM sop)
SELECT ProductGroup, Period, WERKS, ActualQuantity
FROM pg CROSS JOIN months CROSS JOIN (VALUES ('1000'), ('2000')) w (WERKS)
  LEFT JOIN sop USING (ProductGroup, Period, WERKS)"""


# ---- joins ------------------------------------------------------------------------------


def _edge(many: str, many_key: str, one: str, one_key: str, left: str, right: str) -> str:
    columns = [f'm.{_q(c)} AS "{many}_{c}"' for c in left.split()]
    columns += [f'o.{_q(c)} AS "{one}_{c}"' for c in right.split()]
    return f"""SELECT {", ".join(columns)}
FROM {TABLE_CTE[many]} m LEFT JOIN {TABLE_CTE[one]} o ON m.{_q(many_key)} = o.{_q(one_key)}"""


_H, _O, _C = "COOIS_OrderHeaders", "COOIS_OrderOperations", "COOIS_Confirmations"

RAW["j00_marc_mara"] = _edge("MARC", "MATNR", "MARA", "MATNR", "MATNR WERKS", "MATNR MTART")
RAW["j01_mard_mara"] = _edge("MARD", "MATNR", "MARA", "MATNR", "MATNR LGORT LABST", "MATNR MATKL")
RAW["j02_dpart_mara"] = _edge("D_Part", "MATNR", "MARA", "MATNR", "MATNR ABC_Class", "MATNR NTGEW")
RAW["j03_mara_pg"] = _edge(
    "MARA", "ProductGroup", "ProductGroup", "ProductGroup", "MATNR ProductGroup",
    "ProductGroup Description",
)
RAW["j04_mara_hier"] = _edge(
    "MARA", "PRDHA", "ProductHierarchy", "ProductHierarchy", "MATNR PRDHA",
    "ProductHierarchy Level Parent",
)
RAW["j05_marc_mrp"] = _edge("MARC", "DISPO", "MRP_Cntr", "DISPO", "MATNR DISPO", "DISPO Name")
RAW["j06_hdr_mara"] = _edge(
    _H, "Material", "MARA", "MATNR", "Order Material OrderQuantity", "MATNR MTART"
)
RAW["j07_ops_hdr"] = _edge(
    _O, "Order", _H, "Order", "Order WorkCenter MachineTime", "Order StatusShort"
)
RAW["j08_ops_wc"] = _edge(
    _O, "WorkCenter", "WorkCenters", "WorkCenter", "Order WorkCenter SetupTime",
    "WorkCenter Bottleneck",
)
RAW["j09_conf_hdr"] = _edge(_C, "Order", _H, "Order", "Order YieldQuantity", "Order Priority")
RAW["j10_conf_wc"] = _edge(
    _C, "WorkCenter", "WorkCenters", "WorkCenter", "Order WorkCenter ScrapQuantity",
    "WorkCenter NGRAD",
)
RAW["j11_co24_hdr"] = _edge(
    "CO24", "Order", _H, "Order", "Order Component ShortageQuantity", "Order FinishDate"
)
RAW["j12_matdoc_hdr"] = _edge(
    "MATDOC", "Order", _H, "Order", "Order Matnr Quantity", "Order StatusShort"
)
RAW["j13_sop_pg"] = _edge(
    "SOP_Targets", "ProductGroup", "ProductGroup", "ProductGroup",
    "ProductGroup Period TargetQuantity", "ProductGroup Description",
)

RAW["j14_widen"] = """
SELECT c."Order", c.WorkCenter, c.YieldQuantity, h.StatusShort AS COOIS_OrderHeaders_StatusShort,
  m.MTART AS MARA_MTART, g.Description AS ProductGroup_Description
FROM conf c LEFT JOIN hdr h USING ("Order") LEFT JOIN mara m ON m.MATNR = h.Material
  LEFT JOIN pg g ON g.ProductGroup = m.ProductGroup"""


def _orphans(edge: str, many: str, key: str, one: str, one_key: str, kept: str) -> str:
    return f"""
SELECT '{edge}' AS edge, '{many}' AS many, '{one}' AS one, {_q(key)} AS "key", count(*) AS "rows"
FROM {TABLE_CTE[many]} WHERE {_q(key)} IS NOT NULL AND {_q(key)} NOT IN (
  SELECT {_q(one_key)} FROM {TABLE_CTE[one]} WHERE {kept})
GROUP BY {_q(key)}"""


RAW["j15_orphans"] = "\nUNION ALL\n".join(
    [
        *[
            _orphans(e, t, k, "MARA", "MATNR", "MTART = 'FERT'")
            for e, t, k in (
                ("J0", "MARC", "MATNR"),
                ("J1", "MARD", "MATNR"),
                ("J2", "D_Part", "MATNR"),
            )
        ],
        _orphans("J6", _H, "Material", "MARA", "MATNR", "MTART = 'FERT'"),
        *[
            _orphans(e, t, "Order", _H, "Order", "StatusShort <> 'CLSD'")
            for e, t in (("J7", _O), ("J9", _C), ("J11", "CO24"), ("J12", "MATDOC"))
        ],
        *[
            _orphans(e, t, "WorkCenter", "WorkCenters", "WorkCenter", "WERKS = '1000'")
            for e, t in (("J8", _O), ("J10", _C))
        ],
    ]
)

RAW["j16_waiting_orders"] = """
SELECT "Order", StatusShort, FinishDate FROM hdr h
WHERE EXISTS (SELECT 1 FROM co24 c WHERE c."Order" = h."Order" AND MissingPart = 1)"""

RAW["j17_clean_orders"] = """
SELECT "Order", SystemStatus, Priority FROM hdr h WHERE StatusShort <> 'CRTD'
  AND NOT EXISTS (SELECT 1 FROM co24 c WHERE c."Order" = h."Order" AND MissingPart = 1)"""

RAW["j18_matdoc_type"] = """
SELECT "Order", Matnr, MovementType, Quantity, Sign, Direction, CASE Sign WHEN '+' THEN Quantity
  WHEN '-' THEN -Quantity ELSE 0.0::DOUBLE END AS SignedQuantity
FROM matdoc JOIN mtypes USING (MovementType)"""

RAW["j19_component_material"] = """
SELECT "Order", Component, ShortageQuantity, MTART, m.ProductGroup, CriticalPart, ABC_Class
FROM co24 LEFT JOIN mara m ON m.MATNR = Component LEFT JOIN dpart d ON d.MATNR = Component"""

RAW["j20_op_confirmation"] = """
SELECT o."Order", o.Operation, o.WorkCenter, o.TargetQuantity, c.YieldQuantity, c.DelayHours
FROM ops o LEFT JOIN conf c ON c."Order" = o."Order" AND c.Operation = o.Operation"""

RAW["j21_stock_part"] = """
SELECT MATNR, WERKS, DISPO, Stock, SnapshotTime
FROM marc LEFT JOIN (SELECT Part AS MATNR, WERKS, Stock, SnapshotTime FROM stock)
  USING (MATNR, WERKS)"""

RAW["j22_hierarchy"] = """RECURSIVE WITH walk (node, ancestor, distance) AS (
  SELECT ProductHierarchy, ProductHierarchy, CAST(0 AS BIGINT) FROM hier
  UNION ALL
  SELECT node, Parent, distance + 1 FROM walk JOIN hier ON ancestor = ProductHierarchy
  WHERE Parent IS NOT NULL)
SELECT node, ancestor, distance FROM walk"""

RAW["j23_order_controller"] = """
SELECT "Order", Material, h.WERKS, c.DISPO, r.Name AS Controller, r.ResponsibilityArea
FROM hdr h LEFT JOIN marc c ON c.MATNR = Material AND c.WERKS = h.WERKS
  LEFT JOIN mrp r ON r.DISPO = c.DISPO"""

# ---- measures ---------------------------------------------------------------------------

_BY_HEADER = """LEFT JOIN (SELECT "Order" AS ord, StatusShort AS hst, Priority AS prio,
  Material AS mat FROM hdr) h ON h.ord = f."Order" """
_BY_MATERIAL = """LEFT JOIN (SELECT MATNR, MTART, ProductGroup AS pgr FROM mara) m
  ON m.MATNR = h.mat """
_BY_GROUP = """LEFT JOIN (SELECT ProductGroup AS gkey, Description AS gtext FROM pg) g
  ON g.gkey = m.pgr """
_BY_CENTER = """LEFT JOIN (SELECT WorkCenter AS wkey, WERKS AS wplant, Bottleneck AS wflag
  FROM wc) w ON w.wkey = f.WorkCenter """

RAW["m01_order_count"] = f"""
SELECT gkey AS ProductGroup, count(*) AS order_count
FROM (SELECT "Order" FROM hdr) f {_BY_HEADER}{_BY_MATERIAL}{_BY_GROUP} GROUP BY gkey"""
RAW["m02_released_load"] = """
SELECT Priority, count(*) FILTER (contains(upper(SystemStatus), 'REL')) AS released_order_load
FROM hdr GROUP BY Priority"""
RAW["m03_backlog"] = """
SELECT StatusShort, count(*) FILTER (Backlog = 1) AS backlog_order_count
FROM hdr GROUP BY StatusShort"""
RAW["m04_order_qty"] = f"""
SELECT MTART, {_sum("OrderQuantity")} AS total_order_quantity
FROM hdr LEFT JOIN mara ON MATNR = Material GROUP BY MTART"""
RAW["m05_delivered_qty"] = f"""
SELECT StatusShort, {_sum("DeliveredQuantity")} AS total_delivered_quantity
FROM hdr GROUP BY StatusShort"""
RAW["m06_op_count"] = f"""
SELECT wplant AS WERKS, count(*) AS operation_count FROM ops f {_BY_CENTER} GROUP BY wplant"""
RAW["m07_bottleneck_ops"] = f"""
SELECT hst AS StatusShort, count(*) FILTER (BottleneckOperation = 1)
  AS bottleneck_operation_count_laser_balancing
FROM ops f {_BY_HEADER} GROUP BY hst"""
RAW["m08_yield"] = f"""
SELECT gtext AS Description, {_sum("YieldQuantity")} AS total_yield
FROM conf f {_BY_HEADER}{_BY_MATERIAL}{_BY_GROUP} GROUP BY gtext"""
RAW["m09_scrap"] = f"""
SELECT wkey AS WorkCenter, {_sum("ScrapQuantity")} AS total_scrap
FROM conf f {_BY_CENTER} GROUP BY wkey"""
RAW["m10_rework"] = f"""
SELECT prio AS Priority, wplant AS WERKS, {_sum("ReworkQuantity")} AS total_rework
FROM conf f {_BY_HEADER}{_BY_CENTER} GROUP BY prio, wplant"""
_RATE = f"""{_sum("ScrapQuantity")} / nullif({_sum("YieldQuantity")}, 0)"""
RAW["m11_scrap_rate"] = f"""
SELECT gkey AS ProductGroup, {_RATE} AS scrap_rate
FROM conf f {_BY_HEADER}{_BY_MATERIAL}{_BY_GROUP} GROUP BY gkey"""
_DELAY = f"""{_sum("DelayHours")} / count(DelayHours)"""
RAW["m12_avg_delay"] = f"""
SELECT wplant AS WERKS, {_DELAY} AS avg_posting_delay_hours
FROM conf f {_BY_CENTER} GROUP BY wplant"""
RAW["m13_missing_parts"] = f"""
SELECT hst AS StatusShort, count(*) FILTER (MissingPart = 1) AS missing_part_count
FROM co24 f {_BY_HEADER} GROUP BY hst"""
RAW["m14_shortage_qty"] = f"""
SELECT MTART, {_sum("ShortageQuantity")} AS total_shortage_quantity
FROM co24 f {_BY_HEADER}{_BY_MATERIAL} GROUP BY MTART"""
RAW["m15_sop_target"] = f"""
SELECT ProductGroup, {_sum("TargetQuantity")} AS total_target_quantity
FROM sop GROUP BY ProductGroup"""
RAW["m16_sop_actual"] = f"""
SELECT Period, {_sum("ActualQuantity")} AS total_sop_actual_quantity FROM sop GROUP BY Period"""
RAW["m17_sop_deviation"] = f"""
SELECT Description, WERKS, {_sum("Deviation")} AS sop_deviation FROM sop
GROUP BY Description, WERKS"""

RAW["i01_implicit_sum"] = "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", {_sum(_q(c))} AS total FROM {TABLE_CTE[t]}"""
    for t in TABLES
    for c in summable_columns(t)
)
RAW["i02_compose"] = f"""
SELECT wkey AS WorkCenter,
  ({_sum("ScrapQuantity + ReworkQuantity")})
    / nullif({_sum("ScrapQuantity + ReworkQuantity + YieldQuantity")}, 0) AS loss_rate,
  {_RATE} AS scrap_rate
FROM conf f {_BY_CENTER} GROUP BY wkey"""
RAW["i03_filtered_measure"] = """
SELECT StatusShort, Priority, count(*) AS order_count,
  count(*) FILTER (StatusShort = 'REL') AS released_here,
  coalesce(any_value(n), 0) AS released_anywhere
FROM hdr LEFT JOIN (SELECT Priority, count(*) AS n FROM hdr WHERE StatusShort = 'REL'
  GROUP BY Priority) r USING (Priority)
WHERE StatusShort IN ('REL', 'PCNF', 'CNF') GROUP BY StatusShort, Priority"""
RAW["i04_measure_by_dims"] = f"""
SELECT gkey AS ProductGroup, wflag AS Bottleneck, {_sum("YieldQuantity")} AS total_yield,
  {_RATE} AS scrap_rate, {_DELAY} AS avg_posting_delay_hours
FROM conf f {_BY_HEADER}{_BY_MATERIAL}{_BY_GROUP}{_BY_CENTER}
WHERE hst <> 'CRTD' AND DelayHours < 48 GROUP BY gkey, wflag"""
RAW["i05_drill_across"] = f"""
WITH a AS (SELECT ProductGroup, count(*) AS order_count,
    count(*) FILTER (contains(SystemStatus, 'REL')) AS released_order_load
  FROM hdr GROUP BY ProductGroup),
b AS (SELECT pgr AS ProductGroup, count(*) FILTER (MissingPart = 1) AS missing_part_count,
    {_sum("ShortageQuantity")} AS total_shortage_quantity
  FROM co24 f {_BY_HEADER}{_BY_MATERIAL} GROUP BY pgr),
c AS (SELECT ProductGroup, {_sum("Deviation")} AS sop_deviation FROM sop GROUP BY ProductGroup),
d AS (SELECT pgr AS ProductGroup, {_RATE} AS scrap_rate
  FROM conf f {_BY_HEADER}{_BY_MATERIAL} GROUP BY pgr)
SELECT a.ProductGroup, order_count, released_order_load, missing_part_count,
  total_shortage_quantity, sop_deviation, scrap_rate
FROM a LEFT JOIN b ON b.ProductGroup IS NOT DISTINCT FROM a.ProductGroup
  LEFT JOIN c ON c.ProductGroup IS NOT DISTINCT FROM a.ProductGroup
  LEFT JOIN d ON d.ProductGroup IS NOT DISTINCT FROM a.ProductGroup"""

_OUTPUT = f"""{_sum("YieldQuantity")} AS total_yield, {_sum("ScrapQuantity")} AS total_scrap,
  {_sum("ReworkQuantity")} AS total_rework, {_sum("ActualMachineTime")} AS machine_hours,
  {_sum("ActualLaborTime")} AS labor_hours"""
RAW["i06_conf_all"] = f"SELECT WorkCenter, {_OUTPUT} FROM conf GROUP BY WorkCenter"
RAW["i07_stock_total"] = "SELECT Part AS MATNR, WERKS, Stock FROM stock"

# ---- questions and analyses -------------------------------------------------------------

RAW["q1_released_and_backlog"] = """
SELECT StatusShort, CAST(grouping(StatusShort) AS BIGINT) AS subtotal_level, count(*) AS orders,
  count(*) FILTER (contains(SystemStatus, 'REL')) AS released,
  count(*) FILTER (Backlog = 1) AS backlog
FROM hdr GROUP BY ROLLUP (StatusShort)"""
RAW["q2_bottleneck_ops"] = f"""
SELECT count(*) AS operations, count(*) FILTER (BottleneckOperation = 1) AS by_flag,
  count(*) FILTER (wflag = 1) AS by_work_center
FROM ops f {_BY_CENTER}"""
RAW["q3_waiting_orders"] = f"""
WITH w AS (SELECT "Order", count(*) AS n, sum(CAST(ShortageQuantity AS DECIMAL(18, 4))) AS s
  FROM co24 WHERE MissingPart = 1 AND "Order" IN (SELECT "Order" FROM hdr) GROUP BY "Order")
SELECT "Order", CAST(grouping("Order") AS BIGINT) AS subtotal_level, count(*) AS orders,
  CAST(sum(n) AS BIGINT) AS missing_parts, CAST(sum(s) AS DOUBLE) AS shortage_quantity
FROM w GROUP BY ROLLUP ("Order")"""
RAW["q4_top_scrap_group"] = f"""
SELECT gkey AS ProductGroup, {_RATE} AS scrap_rate, {_sum("ScrapQuantity")} AS total_scrap,
  {_sum("YieldQuantity")} AS total_yield
FROM conf f {_BY_HEADER}{_BY_MATERIAL}{_BY_GROUP} GROUP BY gkey
ORDER BY scrap_rate DESC NULLS LAST, ProductGroup LIMIT 1"""
RAW["q5_posting_delay"] = f"""
SELECT WorkCenter, count(DelayHours) AS postings, {_DELAY} AS avg_posting_delay_hours
FROM conf GROUP BY WorkCenter"""
RAW["a01_order_load"] = f"""
SELECT WERKS, ProductGroup, Priority, count(*) AS released_orders,
  {_sum("OrderQuantity")} AS order_quantity,
  {_sum("OrderQuantity - DeliveredQuantity")} AS open_quantity
FROM hdr WHERE contains(SystemStatus, 'REL') GROUP BY WERKS, ProductGroup, Priority"""
RAW["a02_material_buffer"] = f"""
SELECT WorkCenter, count(DISTINCT o."Order") AS orders,
  {_sum("TargetQuantity - ActualQuantity")} AS open_quantity
FROM ops o JOIN hdr h ON h."Order" = o."Order"
WHERE o.StatusShort <> 'CNF' AND contains(h.SystemStatus, 'REL') GROUP BY WorkCenter"""
RAW["a03_utilization"] = f"""
WITH l AS (SELECT WorkCenter, CAST(sum(CAST(SetupTime AS DECIMAL(18, 4))
    + CAST(MachineTime AS DECIMAL(18, 4))) AS DOUBLE) AS h
  FROM ops WHERE StatusShort <> 'CNF' GROUP BY WorkCenter)
SELECT WorkCenter, coalesce(h, 0) AS load_hours, TheoreticalCapacityHrDay AS capacity_hours_per_day,
  coalesce(h, 0) / nullif(TheoreticalCapacityHrDay, 0) AS load_days
FROM wc LEFT JOIN l USING (WorkCenter)"""
RAW["a04_actual_utilization"] = f"""
WITH d AS (SELECT WorkCenter, CAST(ActualEnd AS DATE) AS day, {_sum("ActualMachineTime")} AS h
  FROM conf GROUP BY ALL)
SELECT WorkCenter, day, h AS machine_hours, h / nullif(TheoreticalCapacityHrDay, 0) AS utilization
FROM d LEFT JOIN wc USING (WorkCenter)"""

_RECEIVED = f"""SELECT "Order", {_sum("Quantity")} AS v FROM matdoc
  WHERE MovementType = '101' GROUP BY "Order" """
_REPORTED = """SELECT "Order", arg_max(YieldQuantity, CAST(Operation AS BIGINT)) AS v
  FROM conf GROUP BY "Order" """
RAW["a05_throughput_compare"] = f"""
SELECT coalesce(a."Order", b."Order") AS "Order", a.v AS real_quantity, b.v AS reported_quantity,
  a.v - b.v AS gap
FROM ({_RECEIVED}) a FULL JOIN ({_REPORTED}) b ON a."Order" = b."Order" """
RAW["a06_precedence"] = f"""
WITH keys AS (SELECT "Order" FROM hdr UNION SELECT "Order" FROM ops),
m AS ({_RECEIVED}), c AS ({_REPORTED}),
o AS (SELECT "Order", arg_max(ActualQuantity, CAST(Operation AS BIGINT)) AS v
  FROM ops GROUP BY "Order"),
u AS (SELECT k."Order", m.v AS mv, c.v AS cv, DeliveredQuantity AS hv, o.v AS ov
  FROM keys k LEFT JOIN m USING ("Order") LEFT JOIN c USING ("Order")
    LEFT JOIN hdr USING ("Order") LEFT JOIN o USING ("Order"))
SELECT "Order", coalesce(mv, cv, hv, ov) AS value,
  CASE WHEN mv IS NOT NULL THEN 'movements' WHEN cv IS NOT NULL THEN 'confirmations'
    WHEN hv IS NOT NULL THEN 'headers' ELSE 'operations' END AS source
FROM u WHERE coalesce(mv, cv, hv, ov) IS NOT NULL"""
RAW["a07_delay_profile"] = f"""
WITH r AS (SELECT WorkCenter, DelayHours,
    count(*) OVER (PARTITION BY WorkCenter ORDER BY DelayHours) AS upto,
    count(*) OVER (PARTITION BY WorkCenter) AS n
  FROM conf)
SELECT WorkCenter, count(*) AS postings, {_sum("DelayHours")} AS delay_hours,
  {_sum("DelayHours")} / count(*) AS avg_delay_hours,
  min(DelayHours) FILTER (upto * 100 >= n * 50) AS p50_hours,
  min(DelayHours) FILTER (upto * 100 >= n * 90) AS p90_hours,
  count(*) FILTER (DelayHours <= 1) AS within_1h, count(*) FILTER (DelayHours <= 8) AS within_8h,
  count(*) FILTER (DelayHours <= 24) AS within_24h
FROM r GROUP BY WorkCenter"""
RAW["a08_queue_time"] = """
WITH j AS (SELECT o."Order", o.Operation, o.StartDate, o.FinishDate, c.ActualEnd,
    c.ActualMachineTime, CAST(o.Operation AS BIGINT) AS n
  FROM ops o LEFT JOIN conf c ON c."Order" = o."Order" AND c.Operation = o.Operation),
p AS (SELECT *, lag(FinishDate) OVER w AS before_finish, lag(ActualEnd) OVER w AS before_end,
    row_number() OVER w AS rn
  FROM j WINDOW w AS (PARTITION BY "Order" ORDER BY n))
SELECT "Order", Operation, CAST(StartDate - before_finish AS BIGINT) AS planned_wait_days,
  round(date_diff('second', before_end, ActualEnd) / 3600.0::DOUBLE - ActualMachineTime, 4)
    AS actual_wait_hours
FROM p WHERE rn > 1"""
RAW["a09_prioritize"] = f"""
WITH s AS (SELECT "Order", count(*) AS n, {_sum("ShortageQuantity")} AS q
  FROM co24 WHERE MissingPart = 1 GROUP BY "Order"),
r AS (SELECT h."Order", SOP_Relevant, Backlog, Priority, coalesce(n, 0) AS missing_parts,
    coalesce(q, 0) AS shortage_quantity
  FROM hdr h LEFT JOIN s ON s."Order" = h."Order" WHERE StatusShort IN ('REL', 'PCNF'))
SELECT *, row_number() OVER (ORDER BY SOP_Relevant DESC, Backlog DESC, missing_parts DESC,
  Priority, "Order") AS rank
FROM r ORDER BY rank LIMIT 50"""
RAW["a10_bottleneck_board"] = f"""
WITH c AS (SELECT WorkCenter, TheoreticalCapacityHrDay FROM wc WHERE Bottleneck = 1),
o AS (SELECT ops.* FROM ops JOIN c USING (WorkCenter)),
buf AS (SELECT WorkCenter, count(DISTINCT o."Order") AS buffer_orders
  FROM o JOIN hdr h ON h."Order" = o."Order"
  WHERE o.StatusShort <> 'CNF' AND contains(h.SystemStatus, 'REL') GROUP BY WorkCenter),
ld AS (SELECT WorkCenter, {_sum("SetupTime")} + {_sum("MachineTime")} AS load_hours
  FROM o WHERE StatusShort <> 'CNF' GROUP BY WorkCenter),
cf AS (SELECT WorkCenter, count(*) AS confirmations, {_sum("YieldQuantity")} AS total_yield,
    {_sum("ScrapQuantity")} AS total_scrap
  FROM conf GROUP BY WorkCenter),
ms AS (SELECT "Order", count(*) AS n FROM co24 WHERE MissingPart = 1 GROUP BY "Order"),
rc AS ({_RECEIVED}),
th AS (SELECT WorkCenter, count(*) AS passing_orders, CAST(sum(n) AS BIGINT) AS missing_parts,
    {_sum("v")} AS received_quantity
  FROM (SELECT DISTINCT "Order", WorkCenter FROM o) d LEFT JOIN ms USING ("Order")
    LEFT JOIN rc USING ("Order") GROUP BY WorkCenter)
SELECT WorkCenter, TheoreticalCapacityHrDay AS capacity_hours_per_day, buffer_orders, load_hours,
  confirmations, total_yield, total_scrap, passing_orders, missing_parts, received_quantity
FROM c LEFT JOIN buf USING (WorkCenter) LEFT JOIN ld USING (WorkCenter)
  LEFT JOIN cf USING (WorkCenter) LEFT JOIN th USING (WorkCenter)"""
RAW["a11_output"] = f"""
SELECT WERKS, WorkCenter, CAST(grouping(WERKS, WorkCenter) AS BIGINT) AS subtotal_level,
  {_OUTPUT}, count(*) AS confirmations, {_RATE} AS scrap_rate
FROM conf GROUP BY ROLLUP (WERKS, WorkCenter)"""
RAW["a12_sop"] = f"""
SELECT ProductGroup, WERKS, CAST(grouping(ProductGroup, WERKS) AS BIGINT) AS subtotal_level,
  {_sum("TargetQuantity")} AS target_quantity, {_sum("ActualQuantity")} AS actual_quantity,
  {_sum("Deviation")} AS deviation,
  {_sum("ActualQuantity")} / nullif({_sum("TargetQuantity")}, 0) AS attainment
FROM sop GROUP BY CUBE (ProductGroup, WERKS)"""
RAW["a13_critical_shortage"] = f"""
SELECT ABC_Class, XYZ_Class, count(DISTINCT Component) AS components, count(*) AS missing_parts,
  {_sum("ShortageQuantity")} AS shortage_quantity
FROM co24 JOIN dpart ON MATNR = Component
WHERE MissingPart = 1 AND CriticalPart = 1 GROUP BY ABC_Class, XYZ_Class"""
RAW["a14_stock_cover"] = f"""
WITH n AS (SELECT Component, WERKS, {_sum("ShortageQuantity")} AS s
  FROM co24 WHERE MissingPart = 1 GROUP BY Component, WERKS),
h AS (SELECT MATNR AS Component, WERKS, sum(LABST) AS b FROM mard GROUP BY MATNR, WERKS)
SELECT Component, WERKS, s AS shortage_quantity, coalesce(b, 0) AS stock_quantity,
  least(s, coalesce(b, 0)) AS covered_quantity,
  round(greatest(s - coalesce(b, 0), 0), 4) AS uncovered_quantity
FROM n LEFT JOIN h USING (Component, WERKS)"""
RAW["a15_status_mix"] = """
SELECT StatusShort, count(*) AS orders,
  count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE) AS share
FROM hdr GROUP BY StatusShort"""
RAW["a16_hierarchy_rollup"] = f"""
SELECT 'RE-' || MTART AS ancestor, MTART AS ancestor_text, {_sum("YieldQuantity")} AS total_yield,
  {_RATE} AS scrap_rate
FROM conf f {_BY_HEADER}{_BY_MATERIAL} GROUP BY MTART"""
RAW["a17_throughput_trend"] = """
WITH e AS (SELECT "Order", max(ActualEnd) AS last_end FROM conf GROUP BY "Order")
SELECT strftime(last_end, '%Y%m') AS Period, count(*) AS orders,
  CAST(sum(date_diff('second', CAST(StartDate AS TIMESTAMP), last_end)) AS DOUBLE)
    / count(*) / 3600 AS avg_throughput_hours
FROM e JOIN hdr USING ("Order") GROUP BY Period"""
RAW["a18_consumption"] = f"""
SELECT "Order", Matnr,
  CAST(sum(CASE WHEN Direction = 'GI' THEN CASE Sign WHEN '-' THEN Quantity ELSE -Quantity END
    ELSE 0 END) AS DOUBLE) AS issued,
  CAST(sum(CASE WHEN Direction = 'GR' THEN CASE Sign WHEN '+' THEN Quantity ELSE -Quantity END
    ELSE 0 END) AS DOUBLE) AS received,
  CAST(sum(CASE Sign WHEN '+' THEN Quantity WHEN '-' THEN -Quantity ELSE 0 END) AS DOUBLE) AS net
FROM matdoc JOIN mtypes USING (MovementType) GROUP BY "Order", Matnr"""

# ---- quality checks ---------------------------------------------------------------------

RAW["k01_shortage"] = """
SELECT "Order", Component, round(greatest(Reqmnt_qty - Comm_qty, 0), 1) AS ShortageQuantity,
  ShortageQuantity AS ExpectedShortage
FROM co24
WHERE round(greatest(Reqmnt_qty - Comm_qty, 0), 1) <> co24.ShortageQuantity"""
RAW["k02_delay"] = """
SELECT "Order", WorkCenter, ActualEnd, SAP_PostingTime, ceil(DelayHours) AS DelayHours,
  conf.DelayHours AS ExpectedDelay
FROM conf WHERE ceil(conf.DelayHours) <> conf.DelayHours"""
RAW["k03_backlog"] = """
SELECT "Order", Backlog, CAST(0 AS BIGINT) AS ExpectedBacklog FROM hdr
WHERE Backlog = 1 AND FinishDate >= DATE '1999-01-01'"""
RAW["k04_status"] = """
SELECT "Order", StatusShort, 'REL CNF DLV TECO' AS SystemStatus FROM hdr
WHERE StatusShort = 'CLSD'"""
RAW["k05_delivered"] = """
SELECT "Order", StatusShort, OrderQuantity, DeliveredQuantity + 1 AS DeliveredQuantity FROM hdr
WHERE StatusShort IN ('CRTD', 'REL')
  OR (StatusShort = 'PCNF' AND hdr.DeliveredQuantity + 1 > OrderQuantity)
  OR (StatusShort IN ('CNF', 'DLV', 'TECO', 'CLSD') AND OrderQuantity IS NOT NULL)"""
RAW["k06_capacity"] = """
SELECT WorkCenter, EINZH * AZNOR AS TheoreticalCapacityHrDay,
  wc.TheoreticalCapacityHrDay AS ExpectedCapacity
FROM wc WHERE EINZH * AZNOR <> wc.TheoreticalCapacityHrDay"""
RAW["k07_sop"] = """
SELECT ProductGroup, WERKS, Period, trunc(Deviation) AS Deviation,
  sop.Deviation AS ExpectedDeviation
FROM sop WHERE trunc(sop.Deviation) <> sop.Deviation"""
RAW["k08_dates"] = """
SELECT "Order", CreationDate, StartDate + 2 AS StartDate, FinishDate FROM hdr
WHERE Priority + 2 > 5 OR date_diff('day', hdr.StartDate, FinishDate) < 5"""
RAW["k09_sequence"] = """
WITH p AS (SELECT "Order", Operation, StatusShort, lag(Operation) OVER w AS PreviousOperation,
    lag(StatusShort) OVER w AS PreviousStatus
  FROM ops WINDOW w AS (PARTITION BY "Order" ORDER BY CAST(Operation AS BIGINT)))
SELECT * FROM p WHERE StatusShort = 'CNF' AND PreviousStatus <> 'CNF'"""
RAW["k10_confirmed_only"] = """
SELECT "Order", Operation, count(*) AS confirmations, 'not confirmable' AS rule
FROM conf c WHERE NOT EXISTS (SELECT 1 FROM ops o
  WHERE o."Order" = c."Order" AND o.Operation = c.Operation AND o.StatusShort = 'CNF')
GROUP BY "Order", Operation
UNION ALL
SELECT "Order", Operation, count(*), 'confirmed twice' FROM conf
GROUP BY "Order", Operation HAVING count(*) > 1"""
def _repeated(table: str, source: str, keys: Sequence[str]) -> str:
    text = " || '|' || ".join(f"coalesce(CAST({_q(k)} AS VARCHAR), 'null')" for k in keys)
    return f"""SELECT '{table}' AS "table", {text} AS "key", count(*) AS "rows"
FROM {source} GROUP BY {", ".join(map(_q, keys))} HAVING count(*) > 1"""


RAW["k11_keys"] = "\nUNION ALL\n".join(
    [_repeated(t, TABLE_CTE[t], keys) for t, keys in KEYS.items()]
    + [_repeated("lineitem", "lineitem", ("l_orderkey", "l_linenumber"))]
)
RAW["k12_stock"] = """
SELECT MATNR, WERKS, Stock, LABST AS LocationStock
FROM mard JOIN (SELECT Part AS MATNR, WERKS, Stock FROM stock) USING (MATNR, WERKS)
WHERE LGORT = '0001' AND LABST <> Stock"""

# ---- distinct counts, levels, idle times, layouts -----------------------------------------

RAW["i08_distinct_orders"] = f"""
SELECT gkey AS ProductGroup, wplant AS WERKS,
  count(DISTINCT CASE WHEN f.StatusShort <> 'CNF' THEN f."Order" END) AS orders_waiting,
  count(DISTINCT f.Material) AS materials, count(*) AS operation_count
FROM ops f LEFT JOIN (SELECT "Order" AS ord, SystemStatus AS sys, Material AS mat FROM hdr) h
  ON h.ord = f."Order" {_BY_MATERIAL}{_BY_GROUP}{_BY_CENTER}
WHERE contains(sys, 'REL') GROUP BY gkey, wplant"""
RAW["i09_distinct_drill"] = f"""
WITH a AS (SELECT MTART, prio, count(DISTINCT f."Order") AS orders_confirmed, {_sum("YieldQuantity")} AS y
  FROM conf f {_BY_HEADER}{_BY_MATERIAL} GROUP BY MTART, prio),
b AS (SELECT MTART, prio, count(DISTINCT Component) FILTER (MissingPart = 1) AS components_missing
  FROM co24 f {_BY_HEADER}{_BY_MATERIAL} GROUP BY MTART, prio),
c AS (SELECT MTART, Priority AS prio, count(DISTINCT h.Material) AS materials_ordered
  FROM hdr h LEFT JOIN mara ON MATNR = h.Material GROUP BY ALL),
k AS (SELECT MTART, prio FROM a UNION SELECT MTART, prio FROM b UNION SELECT MTART, prio FROM c)
SELECT k.MTART, k.prio AS Priority, orders_confirmed, y / nullif(orders_confirmed, 0) AS yield_per_order,
  components_missing, materials_ordered
FROM k LEFT JOIN a ON a.MTART IS NOT DISTINCT FROM k.MTART AND a.prio IS NOT DISTINCT FROM k.prio
  LEFT JOIN b ON b.MTART IS NOT DISTINCT FROM k.MTART AND b.prio IS NOT DISTINCT FROM k.prio
  LEFT JOIN c ON c.MTART IS NOT DISTINCT FROM k.MTART AND c.prio IS NOT DISTINCT FROM k.prio"""
RAW["i10_levels"] = f"""
WITH a AS (SELECT gkey AS g, Priority AS p, CAST(grouping(gkey, Priority) AS BIGINT) AS subtotal_level,
    count(*) AS order_count, count(*) FILTER (contains(SystemStatus, 'REL')) AS released_order_load
  FROM (SELECT Priority, SystemStatus, Material AS mat FROM hdr) h {_BY_MATERIAL}{_BY_GROUP}
  GROUP BY ROLLUP (gkey, Priority)),
b AS (SELECT gkey AS g, prio AS p, CAST(grouping(gkey, prio) AS BIGINT) AS subtotal_level,
    {_RATE} AS scrap_rate, {_sum("YieldQuantity")} AS total_yield, count(DISTINCT f."Order") AS orders_confirmed
  FROM conf f {_BY_HEADER}{_BY_MATERIAL}{_BY_GROUP} GROUP BY ROLLUP (gkey, prio)),
c AS (SELECT gkey AS g, prio AS p, CAST(grouping(gkey, prio) AS BIGINT) AS subtotal_level,
    count(*) FILTER (MissingPart = 1) AS missing_part_count
  FROM co24 f {_BY_HEADER}{_BY_MATERIAL}{_BY_GROUP} GROUP BY ROLLUP (gkey, prio)),
k AS (SELECT g, p, subtotal_level FROM a UNION SELECT g, p, subtotal_level FROM b
  UNION SELECT g, p, subtotal_level FROM c)
SELECT k.g AS ProductGroup, k.p AS Priority, k.subtotal_level, order_count, released_order_load, scrap_rate,
  total_yield, missing_part_count, orders_confirmed
FROM k LEFT JOIN a ON a.g IS NOT DISTINCT FROM k.g AND a.p IS NOT DISTINCT FROM k.p AND a.subtotal_level = k.subtotal_level
  LEFT JOIN b ON b.g IS NOT DISTINCT FROM k.g AND b.p IS NOT DISTINCT FROM k.p AND b.subtotal_level = k.subtotal_level
  LEFT JOIN c ON c.g IS NOT DISTINCT FROM k.g AND c.p IS NOT DISTINCT FROM k.p AND c.subtotal_level = k.subtotal_level"""
RAW["i12_case_blind"] = """
SELECT MTART, StatusShort, count(*) AS order_count,
  count(*) FILTER (contains(SystemStatus, 'REL')) AS released_order_load,
  count(DISTINCT SystemStatus) AS statuses
FROM hdr LEFT JOIN mara ON MATNR = Material WHERE StatusShort IN ('REL', 'PCNF', 'CNF') GROUP BY ALL"""
RAW["i11_distinct_rollup"] = """
SELECT w.WERKS, strftime(ActualEnd, '%Y%m') AS Period, count(DISTINCT c."Order") AS orders
FROM conf c LEFT JOIN wc w ON w.WorkCenter = c.WorkCenter GROUP BY ALL"""
# Another way than the query's: how many intervals run between one event and the next.
RAW["a19_idle_time"] = """
WITH iv AS (SELECT WorkCenter AS c, e - s AS b, e FROM (
    SELECT WorkCenter, CAST(epoch(ActualEnd) AS BIGINT) AS e,
      CAST(round(ActualMachineTime * 3600) AS BIGINT) AS s FROM conf) WHERE s > 0 AND WorkCenter IS NOT NULL),
event AS (SELECT c, t, sum(d) AS d FROM (
    SELECT c, b AS t, 1 AS d FROM iv UNION ALL SELECT c, e, -1 FROM iv) GROUP BY c, t),
run AS (SELECT c, t, sum(d) OVER w AS running, lead(t) OVER w AS until
  FROM event WINDOW w AS (PARTITION BY c ORDER BY t)),
cut AS (SELECT c, d, running, greatest(t, d * 86400) AS a, least(until, (d + 1) * 86400) AS z FROM (
    SELECT *, unnest(range(t // 86400, (until - 1) // 86400 + 1)) AS d FROM run WHERE until IS NOT NULL)),
-- Neighbouring stretches of one state are one gap: only a state change ends it.
idle AS (SELECT c, d, sum(z - a) AS idle, max(z - a) AS longest FROM cut WHERE running = 0 GROUP BY c, d),
busy AS (SELECT c, d, sum(z - a) AS busy FROM cut WHERE running > 0 GROUP BY c, d),
day AS (SELECT c, d FROM cut GROUP BY c, d)
SELECT c AS WorkCenter, CAST(DATE '1970-01-01' + CAST(d AS INTEGER) AS DATE) AS day,
  coalesce(busy, 0) / 3600.0::DOUBLE AS busy_hours, coalesce(idle, 0) / 3600.0::DOUBLE AS idle_hours,
  coalesce(longest, 0) / 3600.0::DOUBLE AS longest_gap_hours
FROM day LEFT JOIN busy USING (c, d) LEFT JOIN idle USING (c, d)"""
RAW["a20_delay_sketch"] = """
SELECT strftime(ActualEnd, '%Y%m') AS Period, count(DelayHours) AS postings, CAST(0 AS BIGINT) AS off
FROM conf WHERE DelayHours IS NOT NULL GROUP BY ALL"""
RAW["s09_by_order"] = "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS "table", h.StatusShort, count(*) AS "rows"
    FROM {TABLE_CTE[t]} f JOIN hdr h ON h."Order" = f."Order" GROUP BY h.StatusShort"""
    for t in ("COOIS_OrderOperations", "COOIS_Confirmations", "CO24", "MATDOC")
)
RAW["s10_periods"] = f"""
SELECT Period, n AS "rows", CASE WHEN Period = '199503' THEN 2 ELSE 1 END * y AS total_yield
FROM (SELECT strftime(ActualEnd, '%Y%m') AS Period, count(*) AS n, {_sum("YieldQuantity")} AS y
  FROM conf WHERE year(ActualEnd) = 1995 GROUP BY ALL)"""
RAW["s11_swap"] = f"""
SELECT 'before' AS state, count(*) AS "rows", {_sum("DeliveredQuantity")} AS delivered FROM hdr
UNION ALL
SELECT 'after', count(*), {_sum("DeliveredQuantity")} FROM hdr WHERE StatusShort IN ('CRTD', 'REL', 'PCNF')"""
RAW["k13_checks_on_load"] = """
SELECT 'rows' AS "check", count(*) AS "rows" FROM co24
UNION ALL SELECT 'shortage', count(*) FROM co24
WHERE ceil(ShortageQuantity) <> round(greatest(Reqmnt_qty - Comm_qty, 0), 1)
UNION ALL SELECT 'component', 0
UNION ALL SELECT 'negative', 0"""

ORACLE = {name: with_mart(sql.strip()) for name, sql in RAW.items()}
