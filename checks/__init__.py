"""The driver's tables seen as this package's tables, the registered queries, and their SQL twins."""
