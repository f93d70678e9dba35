"""tillpoint — retail analytics jobs on Spark.

Every job is a pure function ``DataFrame(s) -> DataFrame`` built from native
Spark expressions (no Python UDF). Modules:

* ``sources``   — canonical star-schema tables, the test-data mapping, CSV/Parquet IO
* ``functions`` — column expressions shared by the jobs (money, ratios, labels)
* ``operators`` — composed operators Spark lacks as one call (distributed
                  ranking / NTILE, keep-first, scalar combination)
* ``plans``     — the jobs: audit, sales, inventory, customers, returns, risk, impact
"""

from tillpoint.params import RetailParams, TESTDATA_PARAMS  # noqa: F401

__all__ = ["RetailParams", "TESTDATA_PARAMS"]
