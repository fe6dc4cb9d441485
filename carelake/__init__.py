"""Layered appointment analytics on Spark: raw text -> typed -> star schema -> marts."""
