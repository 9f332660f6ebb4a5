"""Readers of corpora, designs and road networks, and sinks."""
