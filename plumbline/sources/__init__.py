"""Where tables and their metadata come from."""
