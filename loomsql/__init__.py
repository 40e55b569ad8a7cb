"""loomsql: a PySpark-native engine for a PostgreSQL-flavoured analytical SELECT dialect."""

__version__ = "0.1.0"
