"""Readers and inventories."""
