"""Reading catalogs, file listings and data files."""
