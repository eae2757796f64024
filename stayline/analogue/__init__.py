"""The workforce tables as views over the generated test tables."""
