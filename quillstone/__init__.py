"""Clause analytics on Spark: DataFrame-to-DataFrame operators for contract text."""
