"""Values that must be equal to those of the production-control data model."""

from __future__ import annotations

# Key widths of zero-padded numbers.
MATERIAL_WIDTH = 18
ORDER_WIDTH = 18
CONFIRMATION_WIDTH = 12
DOCUMENT_WIDTH = 10

# Order status codes and the cumulative status string of each.
SYSTEM_STATUS = {
    "CRTD": "CRTD",
    "REL": "REL",
    "PCNF": "REL PCNF",
    "CNF": "REL CNF",
    "DLV": "REL CNF DLV",
    "TECO": "REL CNF DLV TECO",
    "CLSD": "REL CNF DLV TECO CLSD",
}

# Meaning of the order status codes.
STATUS_TEXT = {
    "CRTD": "created",
    "REL": "released",
    "PCNF": "partially confirmed",
    "CNF": "confirmed",
    "DLV": "delivered",
    "TECO": "technically completed",
    "CLSD": "closed",
}

# Statuses that count as open, as finished, and as confirmable.
OPEN_STATUSES = ("CRTD", "REL", "PCNF")
FINISHED_STATUSES = ("CNF", "DLV", "TECO", "CLSD")
CONFIRMED_OPERATION_STATUSES = ("CNF", "PCNF")

# Manufacturing roles.
ROLE_TEXT = {
    "TURN": "CNC Turning",
    "MILL": "CNC Milling",
    "WIND": "Winding",
    "LASER": "Laser Balancing",
    "ASSY": "Assembly",
    "PAINT": "Painting",
    "INSP": "Final Inspection",
}
BOTTLENECK_ROLE = "LASER"

# Routing of each product group.
ROUTINGS = {
    "PG10": ("TURN", "MILL", "LASER", "INSP"),
    "PG20": ("TURN", "MILL", "INSP"),
    "PG30": ("MILL", "PAINT", "INSP"),
    "PG40": ("WIND", "ASSY", "LASER", "INSP"),
    "PG50": ("TURN", "INSP"),
}

# Hierarchy node of each product group.
HIERARCHY_NODES = {
    "PG10": "RE01000000",
    "PG20": "RE02000000",
    "PG30": "RE03000000",
    "PG40": "RE04000000",
    "PG50": "RE05000000",
}

# Controller of a product group, by plant.
MRP_CONTROLLERS = {
    ("1000", "PG10"): "101",
    ("1000", "PG20"): "101",
    ("1000", "PG30"): "102",
    ("1000", "PG40"): "103",
    ("1000", "PG50"): "102",
    ("2000", "PG10"): "201",
    ("2000", "PG20"): "201",
    ("2000", "PG30"): "201",
    ("2000", "PG40"): "201",
    ("2000", "PG50"): "201",
}

# Work centre that serves a role, by plant.
ROLE_WORK_CENTERS = {
    ("1000", "TURN"): "WC-TURN01",
    ("1000", "MILL"): "WC-MILL01",
    ("1000", "WIND"): "WC-WIND01",
    ("1000", "LASER"): "WC-LASER01",
    ("1000", "ASSY"): "WC-ASSY01",
    ("1000", "PAINT"): "WC-PAINT01",
    ("1000", "INSP"): "WC-INSP01",
    ("2000", "TURN"): "WC-TURN02",
    ("2000", "MILL"): "WC-TURN02",
    ("2000", "WIND"): "WC-ASSY02",
    ("2000", "LASER"): "WC-LASER02",
    ("2000", "ASSY"): "WC-ASSY02",
    ("2000", "PAINT"): "WC-PAINT01",
    ("2000", "INSP"): "WC-LASER02",
}

# Movement types as (sign, direction).
MOVEMENT_TYPES = {
    "101": ("+", "GR"),
    "102": ("-", "GR"),
    "261": ("-", "GI"),
    "262": ("+", "GI"),
    "531": ("+", "GR"),
    "311": ("0", "TR"),
}

# Plants, storage locations.
PLANTS = ("1000", "2000")
STORAGE_LOCATIONS = ("0001", "0002")

# Hours in a planned working day, least duration of an operation in days.
WORKDAY_HOURS = 8.0
LEAST_OPERATION_DAYS = 0.5
