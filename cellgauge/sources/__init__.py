"""Readers and writers of the file layouts the workflows exchange."""
