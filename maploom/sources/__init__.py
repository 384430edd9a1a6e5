"""Readers and writers of the formats that maps come in and go out."""
