"""Word lists shipped with the package."""
