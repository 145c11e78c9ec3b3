"""Reading and writing tables, profiles, result records and instances."""
