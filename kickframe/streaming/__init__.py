"""Live data: status, events, boards and in-play prices, batch and streaming."""
