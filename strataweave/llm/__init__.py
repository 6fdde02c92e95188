"""Corpus-preparation operators for text: nothing else in the library depends on this subpackage."""
