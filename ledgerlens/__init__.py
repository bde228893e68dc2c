"""Ledgerlens: auditable entity by period metric tables, and corpus preparation, on PySpark."""
