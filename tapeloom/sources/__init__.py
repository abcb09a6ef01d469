"""Reading and writing: record layouts, raw feeds, parsed orders, partitioned Parquet and manifests."""
