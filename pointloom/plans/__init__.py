"""Registered queries with their SQL twins, and the request facade."""
