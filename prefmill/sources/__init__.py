"""Readers and writers. Each names its schema, so no pass over the data is spent on inference."""
