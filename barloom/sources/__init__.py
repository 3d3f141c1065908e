"""Sources and sinks of candles, predictions, artifacts and configuration."""
