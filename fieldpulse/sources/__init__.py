"""Sources: adapters over the given tables, message decoding, file readers."""
