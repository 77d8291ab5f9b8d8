"""Registered query plans; importing the modules fills the catalog."""

from . import extra, graph, memory, ranking, relational, search, sources, text  # noqa: F401
