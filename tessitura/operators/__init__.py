"""DataFrame operators: filters, sequences, preference pairs, groups, mixing and batches."""
