"""Tokenising, language matching, dictionary joins, suggestions and corrections as DataFrame operators."""
