"""Conversion-propensity analytics on Spark.

Every public operator is a ``DataFrame -> DataFrame`` function or a ``Column``
expression builder, so plans stay declarative and Catalyst optimises them end to
end.  Sub-packages:

* ``sources``   – table scans, fixture views, CSV reader, sinks, model persistence
* ``functions`` – Column-level helpers (cleaning, time, JSON, scoring, CRM rules)
* ``operators`` – joins, aggregations, windows, ML and scoring operators
* ``plans``     – registered end-to-end queries and their SQL oracles
* ``streaming`` – micro-batch scoring and the per-key sliding-window throttle
"""

from propensity.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
