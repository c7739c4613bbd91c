"""Sources and sinks for binary record files."""
