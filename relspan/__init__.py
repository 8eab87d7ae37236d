"""Set-based relational algebra, incremental views and versioned tables on Spark."""
