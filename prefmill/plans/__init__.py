"""Whole jobs: the operators in order, with the tables they leave behind."""
