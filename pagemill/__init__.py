"""pagemill: clean product tables from captured marketplace pages, on Spark."""
