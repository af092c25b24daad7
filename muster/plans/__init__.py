"""Plans: listing specs, stand-in tables over the driver data, and the query catalog."""
