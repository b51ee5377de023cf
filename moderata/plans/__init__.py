"""Compositions of the operators.

* ``prep``     raw -> working -> analysed (v1) stages and the funnel steps
* ``queries``  the named queries, ``(spark, sf_dir) -> DataFrame``, plus
               frame-level helpers (``*_of(df)``) for stored tables
* ``oracle``   DuckDB SQL text for the queries SQL can express
* ``suite``    category/automation outputs from one scan (checkpointed counts)
* ``jobs``     analyse a stored working table: CSV extracts and run metrics
"""
