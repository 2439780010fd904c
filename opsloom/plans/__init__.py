"""End-to-end datasets built from the operators."""
