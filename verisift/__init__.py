"""verisift: what files and texts really are, at DataFrame scale."""
