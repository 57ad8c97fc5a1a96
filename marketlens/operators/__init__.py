"""DataFrame operators; each works on every symbol, venue and instant at once."""
