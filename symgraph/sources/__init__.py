"""Where files come from: discovery, snapshots, diffs, the stored graph."""
