"""All registered queries, gathered from the query modules."""

from __future__ import annotations

import importlib

from strophe.plans import registry

MODULES = ("q_detection", "q_text", "q_audits", "q_priors", "q_frames", "q_groups", "q_sequences", "q_models", "q_io")

for _name in MODULES:
    importlib.import_module(f"strophe.plans.{_name}")


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
