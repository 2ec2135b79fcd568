"""Operators of a training-data pipeline (extraction, filtering, duplicates, packing).

Nothing else in the library imports this subpackage.  Each module holds one operator with a general
interface; :mod:`tabwright.llm.queries` registers one query per operator over its whole table.
"""
