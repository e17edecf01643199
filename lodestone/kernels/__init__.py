"""Sequential algorithms on one component at a time, run inside Arrow functions."""
