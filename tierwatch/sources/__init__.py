from tierwatch.sources.table_function import register_taxonomy
from tierwatch.sources.tables import read_table, write_report

__all__ = ["read_table", "register_taxonomy", "write_report"]
