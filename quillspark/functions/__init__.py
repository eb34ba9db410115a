"""Column functions that stay inside Catalyst, and the few vectorised UDFs."""
