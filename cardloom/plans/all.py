"""Importing this module registers all queries."""

from cardloom.plans import lexical, more, store, vectors  # noqa: F401
