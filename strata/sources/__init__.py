"""Reading raw files and tables, writing tables, reports and run records."""
