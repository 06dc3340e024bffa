"""Named queries over the test tables, with the SQL that states their results."""
