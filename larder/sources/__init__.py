"""Readers, writers, table maintenance and the logical tables derived from order data."""
