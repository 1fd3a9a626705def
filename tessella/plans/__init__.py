"""Bindings of the shared test tables and the registered queries with their SQL."""
