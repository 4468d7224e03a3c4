"""The reports. Every report is a function of the tables and of its parameters."""
