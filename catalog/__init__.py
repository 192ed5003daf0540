"""Bindings of the operators to the test tables, each with its check SQL."""
