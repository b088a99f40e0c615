"""Limit-order-book analytics expressed as Spark DataFrame plans."""
