"""querymill: DataFrame operators for preparing and evaluating text-to-SQL data on Spark."""
