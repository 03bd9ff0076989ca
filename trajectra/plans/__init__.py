"""Named queries on the driver's tables (each with its DuckDB twin where SQL can say it)."""

from trajectra.plans.registry import QUERIES, Query, query  # noqa: F401


def load_all() -> dict:
    """Import every query module so that all queries are registered."""
    from trajectra.plans import q_panel  # noqa: F401
    for mod in ("q_joins", "q_score", "q_compare", "q_grid", "q_fit", "q_reports", "q_scan"):
        try:
            __import__(f"trajectra.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"trajectra.plans.{mod}":
                raise
    return QUERIES
