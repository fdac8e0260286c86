"""Sources and sinks: driver tables, derived fixtures, CSV and Parquet stores."""
