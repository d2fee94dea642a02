"""Training-data operators: filters, deduplication, scoring, packing and formatting of text corpora."""
