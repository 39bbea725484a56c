"""Named queries with their default arguments, and the SQL each is checked against."""
