"""Sources and sinks: CSV files, folders of CSV files, tables."""
