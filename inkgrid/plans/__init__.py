"""Stage plans: ordered DataFrame stages with contracts, replay and diffs."""
