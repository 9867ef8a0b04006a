"""Report operators: role DataFrames in, one report DataFrame out."""
