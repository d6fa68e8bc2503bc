"""millrace: dataflow jobs declared as data and planned onto Spark DataFrames."""
