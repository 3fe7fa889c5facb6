"""Distributed operators that the reports, models and monitors share."""
