"""Training-data operators: dedup, decontamination, filtering, extraction,
tokenization, search and language ID as Spark jobs.

Nothing else in the library imports this subpackage; ``queries`` holds the
registry entries that ``__spark_entry__`` adds when the subpackage is present.
"""
