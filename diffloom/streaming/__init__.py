"""The same roll-ups over streams: event-time windows, duplicates within a watermark, budgets with state."""
