"""Column -> Column text functions (all native Spark expressions, no UDFs)."""
