"""Hotspots: spatio-temporal fire-anomaly analytics on Spark DataFrames.

Layout
------
functions/  column expressions (grid snap, decay, scores, projections)
sources/    table readers: driver tables, fixture adapters, landed CSV scans
operators/  relational and model operators (spatial join, densify, threshold,
            decay, quantile forest, neighbours, clustering, explanations)
sinks/      writers (scored fires, year-partitioned upsert, model persistence)
plans/      composed pipelines and the query catalogue used by the driver
streaming/  incremental ingest of landed files with Structured Streaming
"""

from hotspots.session import get_spark, scratch_dir  # noqa: F401
