"""Reading document trees, version history and templates; writing documents."""
