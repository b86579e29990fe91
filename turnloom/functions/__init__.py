"""Part of turnloom; see the package README."""
