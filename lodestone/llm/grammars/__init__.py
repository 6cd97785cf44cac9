"""Grammars of source languages as plain text, and their lexers."""
