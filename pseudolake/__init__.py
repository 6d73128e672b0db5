"""Pseudonymisation of personal data in tables of documents, conversations and token streams."""
