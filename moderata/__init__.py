"""moderata: Spark-native analytics over platform content-moderation decisions.

Plain functions on DataFrames; Catalyst is the optimizer and Spark the engine.

* ``functions``  Column -> Column helpers (derived columns, predicates)
* ``operators``  generic DataFrame operators (shares, comparisons, profiles, sets, joins)
* ``sources``    loaders, listings, nested archives, fixed dimensions, the SoR view
* ``sinks``      partitioned writes, staged overwrite, manifests, run metrics
* ``plans``      preparation stages, named queries and their SQL oracle
* ``streaming``  incremental form of the preparation step over arriving daily dumps
"""

__version__ = "0.1.0"
