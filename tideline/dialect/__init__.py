"""The SQL dialect: tokens, grammar and translation to DataFrames."""
