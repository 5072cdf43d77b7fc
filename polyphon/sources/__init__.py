"""Instance views, payload channels, model tables and sinks."""
