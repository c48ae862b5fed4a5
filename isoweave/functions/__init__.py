"""Functions of the transcript analytics library."""
