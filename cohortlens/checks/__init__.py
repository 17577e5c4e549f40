"""Registered queries with equivalent SQL for an independent engine."""
