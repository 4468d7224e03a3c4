"""Building blocks on DataFrames: filters, lookups, pre-aggregation, order, scenarios."""
