"""Training-data operators: thirteen Spark jobs for building text corpora, each with its own module.

Nothing else in ``landloom`` imports this subpackage.
"""
