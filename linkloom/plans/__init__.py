"""Named queries built from the operators, with the SQL they are compared to."""
