"""commitlens: repository-activity analytics on Spark DataFrames.

Layout:
    sources/    NDJSON ingest with reject accounting, record normalisation,
                bindings of reference-shaped records over the driver tables
    functions/  native column-expression helpers
    operators/  derived tables, rankings, histograms, words, names,
                lookups and change batches (DataFrame -> DataFrame)
    plans/      load jobs and the registered queries with their SQL oracle
    streaming/  Structured Streaming counters and upsert
"""

__version__ = "0.1.0"
