"""A keyed mutation log on Spark: last-writer-wins reads, compaction and durable channels."""
