"""Scans and sinks for layered documents and text exports."""
