"""Operators for preparing training text, built as Spark jobs; nothing else in the library imports them."""
