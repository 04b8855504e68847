"""Queries over the test tables, one or more for each operator."""

from . import aggregates, extras, frames, intervals, languages, learning, scalars, search, sources, streams, windows  # noqa: F401
