"""Where chunks come from: mappings, catalogs, the chunk view, configuration."""
