"""Bindings of the operators to the given tables, with the SQL that checks them."""
