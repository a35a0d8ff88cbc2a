"""Operators as queries over the tables of a folder, with their SQL."""
