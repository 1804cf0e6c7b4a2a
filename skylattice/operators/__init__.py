"""Dataset operators: sampling, tiles, fetching, captions, provisioning, retrieval, models."""
