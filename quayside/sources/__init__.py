"""Tables, pages and sinks."""
