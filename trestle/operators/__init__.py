"""Operators over long-format parameters, rules, edges and claims."""
