"""Tables' sources: files, dictionaries."""
