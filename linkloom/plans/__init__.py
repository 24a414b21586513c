"""Whole runs, the query catalogue and its SQL counterparts."""
