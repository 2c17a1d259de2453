"""Request-plan tables: expansion, totals, gates and combinations."""
