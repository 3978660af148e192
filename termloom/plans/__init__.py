"""Query language and its compilation into one DataFrame plan."""
