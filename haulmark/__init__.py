"""Document and underwriting analytics written as Spark DataFrame operators."""
