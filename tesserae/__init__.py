"""Analytics for tiled image scores, and training-data operators, as Spark plans."""
