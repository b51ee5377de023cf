"""Operators for preparing training corpora, each a function on Spark DataFrames.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when it is present. Modules: ``warc`` (archives as chunked record tables),
``fingerprint`` (improbable-feature digests), ``bpe`` and ``chunk_bpe``
(tokenising, content-defined chunk reuse), ``near_dedup`` (tensored MinHash),
``quality_rules`` (risk-controlled thresholds), ``mixing`` (hash-threshold
histograms), ``url_filter`` (character language models), ``toxicity`` (boosted
trees), ``rans`` (entropy-coded token files), ``fuzzy_lines`` (SimHash line
dedup), ``ranked_search`` (bag deduplication), ``alignment`` (inverted pair
bitmaps across tokenizers), ``repeats`` (merged Burrows-Wheeler transforms).
``graph`` finds connected components, ``common`` holds shared helpers, ``queries`` the registered queries.
"""
