"""DataFrame -> DataFrame operators, grouped by what they do to a table."""
