"""Search specifications and their table form."""
