"""Column functions over binary frames: all native Spark expressions."""
