"""Named queries over the standard tables, with the SQL that gives the same rows."""
