"""Record files in, snapshots and result tables out."""
