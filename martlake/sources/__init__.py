"""Contracts, the versioned table store, landing files and the data generator."""
