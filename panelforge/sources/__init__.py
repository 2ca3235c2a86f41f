from .tables import TABLES, read_table, table_path
from .text import (FUTURE_SCHEMA, PANEL_SCHEMA, read_csv, string_schema,
                   write_csv)

__all__ = ["TABLES", "read_table", "table_path", "PANEL_SCHEMA", "FUTURE_SCHEMA",
           "read_csv", "string_schema", "write_csv"]
