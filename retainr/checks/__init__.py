"""Independent checks: DuckDB oracle SQL with its own copy of the mapping, the order-insensitive
result comparison, the oracle runner and the physical-plan audit."""
