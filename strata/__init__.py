"""strata: layered-document analytics on Spark."""
