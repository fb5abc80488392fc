"""Scalar functions, all of them Column expressions that Catalyst sees through."""
