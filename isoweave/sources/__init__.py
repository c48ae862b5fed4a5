"""Sources of the transcript analytics library."""
