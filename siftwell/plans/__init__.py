"""Query plans: importing the package registers all queries."""

from . import graph_queries, inventory_queries, platform_queries, search_queries, table_queries, text_queries  # noqa: F401
