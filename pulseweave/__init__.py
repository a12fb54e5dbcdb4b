"""Clinical event tables and bedside recordings to a chunked feature dataset, on Spark."""
