"""Training-data operators: each works alone on DataFrames; nothing outside imports this package."""
