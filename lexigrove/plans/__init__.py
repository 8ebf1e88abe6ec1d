"""Registered queries: the modules beside `queries` add theirs to its tables."""

from . import queries  # noqa: F401  first: the others register with it
from . import graph_queries, ontology_queries, source_queries, answer_queries, cycle_queries, batch_queries  # noqa: F401
