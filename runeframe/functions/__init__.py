"""Column functions: alphabet, text clean-up and time parsing."""
