"""Operators that prepare training text: archives, tokens, extraction, classifiers, duplicates, decontamination and shards."""
