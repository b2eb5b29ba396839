"""Readers: domain relations over tables, export files and delta batches."""
