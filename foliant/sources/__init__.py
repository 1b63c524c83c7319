"""Readers and writers of books, lessons, tables of contents, questions and images."""
