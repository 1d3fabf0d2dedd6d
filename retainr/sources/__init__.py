"""Schema registry, typed loaders and writers (CSV, Parquet, JDBC), physical layout, and the
mapping from the driver's tables to the canonical star schema."""
