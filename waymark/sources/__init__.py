"""Where tables come from: the release catalog, Parquet footers, dictionaries."""
