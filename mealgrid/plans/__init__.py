"""Named relations: recommendation, bubbles, details, storage, loading and resolution."""
