"""Query registry: importing ``all_queries`` fills it."""
