"""Training-data operators: scoring, de-duplication, decontamination, archives, mixing."""
