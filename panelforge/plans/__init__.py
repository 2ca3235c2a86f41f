"""Query plans: fixtures derived from the tables and the registered queries."""
