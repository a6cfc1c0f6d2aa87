"""Plans: the rule-based run, and the registered queries with their oracles."""

import importlib


def all_queries():
    """(queries, oracles) of all modules that register some."""
    from probatio.plans import registry

    for name in ("q_scan_text", "q_entities", "q_dedup", "q_timeline", "q_patterns", "q_ai", "q_reports", "q_streams"):
        try:
            importlib.import_module(f"probatio.plans.{name}")
        except ModuleNotFoundError as exc:
            if exc.name != f"probatio.plans.{name}":
                raise
    return registry.QUERIES, {name: registry.with_tables(sql) for name, sql in registry.ORACLES.items()}
