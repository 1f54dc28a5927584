"""Ring-level fraud analytics over payment-account event streams, as Spark DataFrame programs."""
