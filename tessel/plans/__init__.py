"""From SQL text to DataFrames: tokens, statements, expressions."""
