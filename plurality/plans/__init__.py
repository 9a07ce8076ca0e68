"""Plans: registered queries and their parameters, report documents,
preparation, and the DuckDB oracle SQL."""
