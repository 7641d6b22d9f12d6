"""Stores made of the driver tables, for the registered queries and the tests; no part of the library."""
