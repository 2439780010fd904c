"""Column-level helpers; every function returns a ``Column`` and stays inside whole-stage codegen."""
