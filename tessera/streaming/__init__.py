"""Online learning over partitions and streams."""
