"""Operators for training text; nothing else in the package imports this one."""
