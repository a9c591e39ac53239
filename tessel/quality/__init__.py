"""Operators on the quality of large tables: profiles, orphans, parsing, drift, hot keys and differences."""
