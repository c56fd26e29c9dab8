"""strata: refine tables in layers on Spark and keep a catalog of what is in them."""
