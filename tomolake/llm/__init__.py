"""Training-data operators: tokenisation, archives, classifiers, near-duplicates, decontamination, chat and counts."""
