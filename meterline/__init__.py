"""meterline: usage analytics for the logs that AI coding agents leave behind, on Spark."""
