"""Session and storage plumbing shared by the operators."""
