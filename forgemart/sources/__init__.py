"""Mart tables: schemas, storage, and the binding of order/line-item data to mart roles."""
