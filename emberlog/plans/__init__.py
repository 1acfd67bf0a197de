"""Query registry over the driver's tables: adapters, queries and their SQL equivalents."""
