"""Binary-frame analytics on Spark: checksummed compressed frames as columns of ordinary DataFrames."""
