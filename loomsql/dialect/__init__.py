"""The SELECT dialect: syntax trees, parser, binder, and its rendering as Spark SQL."""
