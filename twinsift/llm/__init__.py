"""Training-data operators: near and exact duplicates, classifiers, language model, scans, tokenizers, extraction."""
