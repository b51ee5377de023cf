"""Generic DataFrame operators; every one takes column names as arguments.

* ``shares``     count per group, share within a coarser group, conditional share, arg-max
* ``compare``    rate against a base dimension, period-over-period deviation
* ``joins``      null-safe equi-join, size-checked broadcast, keyless scalar attach
* ``order``      mixed-direction sort with a total tie-break, ordered and per-group heads
* ``overlap``    set overlap, unmapped codes, presence mask, union
* ``harmonize``  mapping joins (rows and counts), anomaly lookups with zeros kept
* ``profile``    null/missing reports, distincts (exact, HLL, hash-first), screening
                 profile, top-N values, string stats, constant columns, multiplicity
* ``funnel``     filter funnel, date range, midnight check, ratios, agreement counts
"""
