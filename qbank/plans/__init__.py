"""Queries: each row id of the operator inventory over the driver tables, with an SQL oracle where SQL can say it."""
