"""Training-data operators: each module holds one operator that a corpus pipeline can call."""
