"""Whole analyses chained from the operators, and the registered queries with their SQL."""
