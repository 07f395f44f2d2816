"""Reports as text."""
