"""Queries registered with the driver, the stand-in source tables they read, and their SQL oracles."""
