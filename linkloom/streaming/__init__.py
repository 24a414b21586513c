"""Blocking of records that arrive as a stream, against an index that stands still."""
