"""Session set-up, shared storage and skew handling used by every operator."""
