"""Operators of a training-data pipeline (corpus scale), one module each.

Nothing outside this folder imports it; `__spark_entry__` adds its queries when it is present.
"""
