"""Engagement analytics over text posts, as plain DataFrame functions."""
