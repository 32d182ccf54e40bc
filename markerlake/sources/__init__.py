"""Readers and writers of image containers."""
