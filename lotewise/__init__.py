"""Listings analytics on Spark: extraction, merge, entity resolution and faceted queries."""
