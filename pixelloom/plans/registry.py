"""All registered queries of the canvas jobs."""

from __future__ import annotations

from pixelloom.plans import canvas_queries, complexity_queries, composition_queries, entropy_queries, learning_queries, more_queries, normalised_queries, preparation_queries, series_queries, sliced_queries, state_queries, table_queries, training_queries, user_queries

MODULES = [preparation_queries, composition_queries, canvas_queries, state_queries, series_queries, user_queries, training_queries, complexity_queries, entropy_queries, learning_queries, table_queries, more_queries, sliced_queries, normalised_queries]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
