"""Readers, sinks, generators and the star schema."""
