"""Training-data operators: quality, search, packing, safety, formatting,
mixing, near-duplicate joins, token counts and personal data.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries and their SQL; each other module is one operator.
"""
