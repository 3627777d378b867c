"""Logical plans: schemas and the queries that are put together from operators."""
