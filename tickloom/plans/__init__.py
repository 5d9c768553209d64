"""Views of the given tables, jobs made of operators, and the catalogue of registered queries."""
