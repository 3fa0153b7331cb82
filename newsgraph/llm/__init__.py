"""Corpus-preparation operators: encoding, scanning, search, de-duplication and mixing."""
