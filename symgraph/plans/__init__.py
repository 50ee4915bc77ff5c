"""Logical plans: the graph of tables, bounded traversal, SQL over views."""
