"""Typed, exact analytics operators for Apache Spark.

Every operator is a function from DataFrame to DataFrame (or from Column to Column). Sub-packages:

* ``functions``  scalar Column functions: exact arithmetic, time, text, options, lookups
* ``operators``  DataFrame operators: projection, joins, summaries, ordered analytics, contracts, lineage
* ``sources``    framed text, generation-based Parquet datasets, exports
* ``streaming``  Structured Streaming twins of the ordered operators
* ``plans``      the registered queries and their reference SQL
"""

from plumbline.session import configure, load, run_folder

__all__ = ["configure", "load", "run_folder"]
