"""Catalogue analytics on Spark: contracts, ratings, pack sizes, matching, matrix and audits."""
