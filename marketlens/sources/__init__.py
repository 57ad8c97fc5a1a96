"""Input tables: raw venue payloads, and market facts projected from the driver's tables."""
