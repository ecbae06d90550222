"""tessera: tabular analytics workloads expressed as Spark DataFrame jobs.

Sub-packages
------------
sources    readers / writers (delimited text, headerless files, slices, parquet)
functions  scalar Column builders (text, dates, encodings)
operators  DataFrame -> DataFrame operators (profiles, joins, reshape, ranking,
           aggregates, sampling, regression, classification, time series)
plans      bindings of the operators to the test tables, one module per workload
streaming  empty: no workload reads a stream
llm        training-data operators over text tables; nothing else imports it
"""

from tessera.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
