"""Tables, shared folders and the directory store."""
