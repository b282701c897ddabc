"""Schemas, readers, writers and encodings of the tables the engine works on."""
