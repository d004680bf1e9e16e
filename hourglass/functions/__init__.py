"""Column expressions: piecewise maps, calendar fields, quality rules, unit conversion."""
