"""Literature-discovery analytics expressed as Spark DataFrame programs."""
