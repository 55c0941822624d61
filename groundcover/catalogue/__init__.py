"""Registered queries: each runs an operator over the driver tables.

Where SQL can say the same, the query has a second, independent formulation for
comparison.
"""
