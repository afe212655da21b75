"""Plans: parser packs, normalization and the registered queries."""
