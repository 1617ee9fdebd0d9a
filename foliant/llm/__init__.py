"""Operators that prepare training corpora.  Nothing else in foliant imports this."""
