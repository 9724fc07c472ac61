"""Operators for large-scale training-data work. Nothing else in the package imports this one."""
