"""Training-data operators: deduplication, decontamination, language, quality, tokens, chat."""
