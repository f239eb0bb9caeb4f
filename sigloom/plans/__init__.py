"""Named queries over the driver tables, each beside the SQL that states its result."""
