"""Training-data operators: text classifiers, similarity joins, deduplication, packing, archives.

Nothing outside this subpackage imports it.
"""
