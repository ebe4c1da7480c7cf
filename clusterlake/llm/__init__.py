"""Training-data operators: packing, deduplication, scoring, tokenising, media, chat and licences."""
