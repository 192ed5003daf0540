"""assayspark: bioactivity-style analytics as plain PySpark DataFrame operators.

Every operator takes DataFrames and returns DataFrames; none opens its own
session, and none uses a Python UDF.  Sub-packages:

* ``functions``  column expressions (labels, text, set and vector measures)
* ``operators``  filters, statistics, ranking, similarity joins, clustering, metrics
* ``sources``    readers, writers, stages cut into a shared folder
* ``plans``      whole jobs: extract, feature preparation, models, run reports
* ``streaming``  which row-wise operators also run on a streaming DataFrame
"""
