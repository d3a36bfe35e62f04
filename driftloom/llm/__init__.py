"""Training-data operators: language ID, filtering, de-duplication, tokenising, packing, archives.

Nothing else in the library imports this subpackage.
"""
