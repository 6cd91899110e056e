"""navlens — clickstream UX analytics as lazy Spark DataFrame operators.

Inputs are two tables: ``visits`` (one row per session, carrying the list of
its hit ids in ``watch_ids``) and ``hits`` (one row per page view). Every
operator is a plain function ``DataFrame(s) -> DataFrame`` built from native
Spark SQL expressions, joins, aggregates and windows, so Catalyst plans it and
whole-stage codegen runs it; no Python UDF sits on a hot path.
"""

from navlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
