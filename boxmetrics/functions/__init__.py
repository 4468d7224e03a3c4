"""Column expressions: units and currency, fit, cost, and aggregates over counted rows."""
