"""pricemill: supplier price-list analytics on Spark DataFrames."""
