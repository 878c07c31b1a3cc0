"""Training-data operators: search, tokens, quality, secrets, decontamination, archives, scoring, copies."""
