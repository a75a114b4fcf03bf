"""Sharded SQL over Spark: logical schemas, sharding functions, routed scans and writes."""
