"""Whole validations put together from the operators."""
