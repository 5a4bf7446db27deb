"""Where text, dictionaries and settings come from."""
