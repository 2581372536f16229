"""Names, types and calendar values, in plain Python and as column expressions."""
