"""Training-data operators: tokenizing, deduplication, packing, language ID, media, search.

Nothing else in the library imports this subpackage; ``queries.py`` lists what it registers.
"""
