"""Parsers in plain Python: text in, rows out. Spark runs them in ``extract``."""
