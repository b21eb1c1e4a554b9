"""Assignment of streamed points to a frozen model."""
