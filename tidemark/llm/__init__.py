"""Training-data operators: search, quality, near-duplicates, chat formatting, language models, sharding,
packing, tokenizing, language identification and page extraction.  Nothing outside this subpackage imports it."""
