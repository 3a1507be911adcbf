"""Operators for preparing large text and bibliographic collections.

Nothing outside this subpackage imports it; ``queries.py`` and ``sql.py`` hold its entries for
``__spark_entry__``.
"""
