"""Bounded, differentially private analytics over multi-site tables, on PySpark."""
