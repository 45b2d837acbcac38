"""Training-data operators: extraction, filtering, search, deduplication and mixing of text corpora.

Nothing else in the package imports this subpackage.
"""
