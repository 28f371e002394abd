"""Query catalogue, SQL counterparts and stage runner."""
