"""Conversation, tool-output and event-log analytics written as Spark jobs."""
