"""Operators for preparing training corpora: each module is one operator, ``queries`` applies them to the tables."""
