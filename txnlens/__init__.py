"""txnlens — card-transaction fraud analytics as Spark DataFrame operators.

Stages: ``sources`` (raw readers, fixture derivation, sinks) -> ``operators``
(clean/validate/audit, features, KPI / customer / geography / transaction
reports) -> ``plans`` (session, checked broadcasts, catalog, batch run).
"""

__version__ = "0.1.0"
