"""Relational operators on statements and ledgers."""
