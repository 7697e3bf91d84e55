"""Listing and decoding of image files."""
