"""Column-level building blocks: seeded hashing, normal and gamma functions."""
