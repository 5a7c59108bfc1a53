"""Sources, sinks and versioned datasets."""
