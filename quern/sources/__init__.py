"""Term index and evaluation files."""
