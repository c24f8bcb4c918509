"""Tests of the training-data operators; a package, as file names repeat."""
