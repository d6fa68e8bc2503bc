"""From a job to DataFrames."""
