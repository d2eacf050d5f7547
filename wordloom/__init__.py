"""Lexical analytics as Spark jobs: corpus signals, lexicons, look-ups and keystroke sessions."""
