"""fundscope: funding-opportunity analytics as Spark DataFrame jobs.

Layout
------
functions/   Column -> Column expressions (text extraction, derivations, URLs)
operators/   DataFrame -> DataFrame operators (metrics, search, merge, quality, pages)
sources/     scans and sinks (parquet tables, JSON records, envelopes, dimensions)
plans/       test-binding views over the driver tables and the query catalog
streaming/   Structured Streaming forms of upsert and windowed counts
"""

__version__ = "0.1.0"
