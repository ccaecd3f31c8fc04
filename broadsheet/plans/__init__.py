"""Query façade, canned queries and the catalogue of queries with their SQL."""
