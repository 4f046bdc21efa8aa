"""Conversation and work-item analytics on Spark DataFrames."""
