"""Edge and vector readers, driver-table graphs, result sinks."""
