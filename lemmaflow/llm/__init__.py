"""Training-data preparation: de-duplication, filtering, mixing, packing and search.

Nothing outside this subpackage imports it.
"""
