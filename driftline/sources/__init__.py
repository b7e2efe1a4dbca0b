"""Readers of sensor exports and logs into typed DataFrames."""
