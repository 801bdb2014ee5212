"""Whole jobs put together from operators, and the register of queries."""
