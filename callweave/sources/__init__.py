"""Sources and sinks: corpus scan, driver tables, history files, exports."""
