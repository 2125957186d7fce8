"""Writing catalogs, pages and data tables."""
