"""Operators that prepare texts and code for language-model training.  Nothing outside imports this subpackage."""
