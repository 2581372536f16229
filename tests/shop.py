"""A small shop schema for the checks."""

from plumbline.sources.catalog import ColumnMeta as C
from plumbline.sources.catalog import ForeignKey, TableMeta


def shop():
    return [
        TableMeta("users", columns=[C("id", "INTEGER", is_primary_key=True), C("name", "VARCHAR(100)"), C("email", "VARCHAR(255)")], primary_keys=["id"], row_count=1000),
        TableMeta("orders", columns=[C("id", "INTEGER", is_primary_key=True), C("user_id", "INTEGER", is_foreign_key=True), C("total", "DECIMAL(10,2)"), C("order_date", "DATE")], primary_keys=["id"], foreign_keys=[ForeignKey("user_id", "users", "id")]),
        TableMeta("order_items", columns=[C("order_id", "INTEGER"), C("quantity", "INTEGER")], foreign_keys=[ForeignKey("order_id", "orders", "id")]),
        TableMeta("shipments", columns=[C("order_id", "INTEGER"), C("cost", "DECIMAL(10,2)")], foreign_keys=[ForeignKey("order_id", "orders", "id")]),
    ]
