"""Plans: fixture views over the test tables, and the catalogue of registered queries."""
