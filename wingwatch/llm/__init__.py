"""Training-data pipeline operators (language id, deduplication, quality, tokens, chat,
host rules, decontamination, mixing, secrets).  Nothing outside this subpackage imports it."""
