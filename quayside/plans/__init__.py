"""The registered queries: operators applied to the driver's tables, and SQL with the same rows."""
