"""Spark jobs for document retrieval, resume search and conversation analytics."""
