"""Where tables come from: rows, folders of Parquet, CSV or JSON, and the driver's star schema."""
