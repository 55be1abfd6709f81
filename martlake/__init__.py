"""martlake: a retail and web-event lakehouse engine expressed as plain DataFrame functions."""
