"""Relational operators over keyed rows and cells."""
