"""farelens: fare analytics and price forecasting on Spark.

Every public operator is a ``DataFrame -> DataFrame`` function built from
``pyspark.sql.functions`` expressions (or ``pyspark.ml`` estimators), so it
composes with ``DataFrame.transform`` and stays inside Catalyst/Tungsten.

Layout
------
``sources``    table readers, fixture views over the driver tables, sinks
``functions``  column-expression builders (dates, bands, lookups, scores)
``operators``  DataFrame operators (cleaning, features, joins, analytics,
               encoding/scaling/splitting, models, booking and what-if)
``plans``      composed jobs (preparation chain, route report, flagship)
``streaming``  the row-local stages applied to a streaming source
"""

from farelens.session import get_session, checkpoint_root

__all__ = ["get_session", "checkpoint_root"]
