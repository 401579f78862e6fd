"""Sources and sinks, and adapters for libraries that may be absent."""
