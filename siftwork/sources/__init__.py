"""Sources: the tables that queries read."""
