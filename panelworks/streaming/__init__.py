"""Recurring jobs as Structured Streaming queries, each with its batch twin."""
