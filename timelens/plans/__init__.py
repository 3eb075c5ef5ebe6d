"""Compositions of operators: the batch jobs and the chart pages."""
