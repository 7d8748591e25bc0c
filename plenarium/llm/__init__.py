"""Training-data operators: sharding, search, dedup, language, privacy, chat, packing, tokens."""
