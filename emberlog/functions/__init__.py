"""Scalar functions: every one takes and returns Columns, so plans stay inside Catalyst."""
