"""Training-data operators: packing, token counts, deduplication, filters and scoring."""
