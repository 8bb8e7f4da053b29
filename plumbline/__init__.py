"""plumbline: record intelligence as DataFrame-to-DataFrame operators on Spark.

Layout
------
functions/   Column-level building blocks (text, names, contacts, rule tables)
operators/   DataFrame operators (keyed merges, joins, extraction, graph, search)
sources/     readers, record normalisers and sinks
plans/       rule tables and the batch stages that wire the operators together
streaming/   incremental ingest and rolling activity
catalog/     registered queries bound to the shared tables, with their SQL checks
"""

from plumbline.session import get_spark

__all__ = ["get_spark"]
