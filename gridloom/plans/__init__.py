"""Runs, command line, and the registered queries with their oracles."""
