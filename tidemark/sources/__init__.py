"""Sources and sinks: table slices, ledgers, archives, run logs, candle caches."""
