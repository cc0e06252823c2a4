"""All registered queries and their DuckDB twins, gathered by job."""
from __future__ import annotations

import importlib

JOB_MODULES = (
    "pagemark.plans.admission_job",
    "pagemark.plans.routing_job",
    "pagemark.plans.pages_job",
    "pagemark.plans.snapshots_job",
    "pagemark.plans.outcomes_job",
    "pagemark.plans.policy_job",
    "pagemark.plans.streaming_job",
)


def _modules():
    for name in JOB_MODULES:
        try:
            yield importlib.import_module(name)
        except ModuleNotFoundError as e:
            if e.name != name:
                raise


def queries():
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _modules():
        out.update(getattr(m, "ORACLE", {}))
    return out
