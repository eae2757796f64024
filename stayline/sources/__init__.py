"""Table readers, normalisation and sinks."""
