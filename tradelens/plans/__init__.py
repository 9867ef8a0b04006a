"""Query registry, SQL oracle, batch runner and physical layout helpers."""
