"""Set-based operators over the event log."""
