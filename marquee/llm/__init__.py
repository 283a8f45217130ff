"""Training-data operators over whole corpora: filtering, deduplication, formatting, tokens, shards."""
