"""Registered queries with their oracle SQL, test-table bindings, and the run plan."""
