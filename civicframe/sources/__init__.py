"""Readers and writers for the file forms that case and civic data come in."""
