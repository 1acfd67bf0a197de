"""Word lists, ports, address ranges, patterns and rule tables."""
