"""Operators over tables: filters, joins, windows and rebuilds."""
