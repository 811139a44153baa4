"""Training-data operators: de-duplication, language id, mixing, tokenising and scoring on Spark.

Nothing else in the library imports this subpackage.
"""
