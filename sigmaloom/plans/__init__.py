"""Contracts, prepared datasets and the registered queries."""
