"""Relational operators over canonical segments and tokens."""
