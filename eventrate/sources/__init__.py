"""Reading records and writing reports."""
