"""vicinal: similarity search over DataFrames."""
