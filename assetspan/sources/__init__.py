"""Reading and publishing snapshots."""
