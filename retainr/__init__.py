"""retainr: retention, segmentation, experiment and churn analytics as lazy Spark DataFrame plans.

Every analysis is a function ``f(tables..., params...) -> DataFrame`` built from native Spark
expressions, so Catalyst prunes columns, pushes filters into the Parquet scan and AQE re-plans
joins at run time.  Sub-packages:

* ``sources``   schema registry, typed CSV/Parquet/JDBC loaders and writers, driver-table mapping
* ``functions`` scalar column helpers (dates, safe division, formatting)
* ``operators`` distributed operators Spark lacks (exact global rank / NTILE, checked broadcast,
                threshold scan)
* ``plans``     the analyses: cohorts, RFM, experiments, KPIs, features, churn model, data quality
* ``streaming`` incremental ingestion of new table drops with Structured Streaming
* ``checks``    DuckDB SQL used as an independent oracle in tests
"""

__version__ = "0.1.0"
