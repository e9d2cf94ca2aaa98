"""Results that grow with arriving captures."""
