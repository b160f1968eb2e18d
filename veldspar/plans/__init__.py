"""Registered queries, their SQL, and the tables derived for them."""
