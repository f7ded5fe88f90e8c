"""Trial-level behavioural experiments on Spark.

Every operator takes and returns DataFrames, so pipelines are built with
``DataFrame.transform`` and planned by Catalyst as one query.
"""
