"""One check per operator: the Spark query, and the same result in plain SQL."""
