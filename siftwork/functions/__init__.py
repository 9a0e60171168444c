"""Column functions: the filter language, intervals and scalar helpers."""
