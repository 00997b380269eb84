"""Search pipelines and the plans that queries are made of."""
