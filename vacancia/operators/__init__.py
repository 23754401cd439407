"""Operators over postings, applications, companies and sources."""
