"""Registered queries: each pairs a Spark plan with the SQL that must give the same rows."""
