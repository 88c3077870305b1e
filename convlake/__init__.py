"""Conversation lake: conversation logs at corpus scale, on Spark."""
