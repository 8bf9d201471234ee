"""Set-based operators over bars, signals, snapshots and trades."""
