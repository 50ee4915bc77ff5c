"""Scalar expressions, built from Spark's own functions wherever these can express them."""
