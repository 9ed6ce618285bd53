"""The registered queries by topic."""

from graphloom.queries import derived, graphs, joined, reading, text  # noqa: F401
