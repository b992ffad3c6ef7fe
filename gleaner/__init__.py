"""Candidate generation and offline evaluation for user-item interactions, on Spark."""
