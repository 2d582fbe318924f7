"""Operators on point tables: pairs, K functions, simulations and cube queries."""
