"""Training-data operators: fingerprints, extraction, mixing, quality, tokens, joins, search,
URL rules, web archives and language-model scoring. Nothing outside this package imports it."""
