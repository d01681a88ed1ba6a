"""tidelog: bitemporal event-history analytics expressed as Spark DataFrames."""
