"""Ledgerlens subpackage."""
