"""Files as tables of text."""
