"""Statistical models fitted from aggregates that Spark computes."""
