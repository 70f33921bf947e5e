"""Named queries over the library's operators, each with its SQL."""
