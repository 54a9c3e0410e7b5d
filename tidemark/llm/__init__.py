"""Training-data operators: tokenising, scoring, deduplication, filtering and placement of documents."""
