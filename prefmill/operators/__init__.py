"""DataFrame -> DataFrame building blocks. All are lazy; none collects rows on the driver."""
