"""Credit-product recommendation and decision analytics as Spark table jobs."""
