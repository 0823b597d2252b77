"""Training-data operators: filters, near-duplicate search, packing, archives and mixes.

The subpackage stands alone: nothing outside it imports it. Each operator module
has a general interface; ``queries.py`` has the thin ``opN_<name>`` queries.
"""
