"""Datasets on disk and tables derived for tests."""
