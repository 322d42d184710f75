"""Where relations come from and go to: tables, operation logs, snapshots."""
